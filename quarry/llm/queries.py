"""The queries of this package, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op10_bpe
from .cross_polytope import op9_near_vectors
from .forest import op1_nearest
from .mixing import op3_mix_sources
from .quality import op4_quality
from .shingle_join import op2_shingle_join
from .substring import op8_drop_earlier_windows
from .suffix_dedup import op6_suffix_dedup
from .token_output import op5_token_output
from .warc import op7_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_nearest": op1_nearest,
        "op2_shingle_join": op2_shingle_join,
        "op3_mix_sources": op3_mix_sources,
        "op4_quality": op4_quality,
        "op5_token_output": op5_token_output,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_warc": op7_warc,
        "op8_drop_earlier_windows": op8_drop_earlier_windows,
        "op9_near_vectors": op9_near_vectors,
        "op10_bpe": op10_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {}

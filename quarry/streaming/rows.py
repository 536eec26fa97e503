"""Row-wise operators on streams: they keep no state, so they need no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import safety, slips


def screened(stream: DataFrame, text: str = "text") -> DataFrame:
    """Redacted text and suspicious phrases of each row, as it arrives."""
    return stream.withColumn("injections", safety.injections(text)).withColumn(text, safety.redact(text))


def extracted(stream: DataFrame) -> DataFrame:
    """Slip records of a stream of (id, slip_text), unchecked ones marked by their violations."""
    return slips.parse_slips(stream).withColumns({"violations": slips.violations(), "arithmetic_warnings": slips.arithmetic_warnings()})

"""Command line: ``python -m quarry browse|check|health``."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from .operators import golden
from .plans.answer import health
from .schemas import CHUNKS, GOLDEN
from .session import session
from .sources import jsonl


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quarry")
    kinds = top.add_subparsers(dest="command", required=True)
    browse = kinds.add_parser("browse", help="list sections, or the chunks of a section or with a keyword")
    browse.add_argument("chunks", help="JSON lines of chunks")
    browse.add_argument("--sections", action="store_true")
    browse.add_argument("--section")
    browse.add_argument("--keyword")
    browse.add_argument("--limit", type=int, default=50, help="rows to print")
    check = kinds.add_parser("check", help="check a golden set against chunks; exits with 1 if there are errors")
    check.add_argument("golden", help="JSON lines of questions")
    check.add_argument("chunks", help="JSON lines of chunks")
    kinds.add_parser("health")
    return top


def entries(spark, path: str):
    """Golden rows (pos: the line, fields) of a file; a field that a line lacks is no key."""
    lines = jsonl.numbered(spark, path).filter(F.length(F.trim("value")) > 0)
    return lines.select(F.col("line").alias("pos"), F.from_json("value", "map<string,string>").alias("fields"))


def main(args: list[str] | None = None) -> int:
    given = parser().parse_args(args)
    spark = session()
    if given.command == "health":
        print(health(spark))
        return 0
    chunks = jsonl.read_strict(spark, given.chunks, CHUNKS)
    if given.command == "browse":
        found = golden.browse(chunks, given.sections, given.section, given.keyword)
        for row in found.orderBy(found.columns[0]).limit(given.limit).collect():
            print(row.snippet if given.keyword and not given.sections and not given.section else row[0])
        return 0
    jsonl.read_lenient(spark, given.golden, GOLDEN)  # bad lines raise, with their numbers
    rows = entries(spark, given.golden)
    errors = golden.dq_report(rows, chunks).orderBy("pos", "check_no", "detail").limit(1000).collect()
    for e in errors:
        print(f"line {e.pos}: check {e.check_no}: {e.detail}")
    full = golden.complete(rows)
    for column in ("category", "difficulty"):
        print(column, {r[0]: r.n for r in golden.count_by(full, column).collect()})
    return int(bool(errors))


if __name__ == "__main__":
    raise SystemExit(main())

"""Run bookkeeping: log markers, log tails, run naming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

MARKER = r"^\s*(?:New batch run:|Resuming batch in:)\s*(.*?)\s*$"


def run_dir_from_log(lines: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Directory named by the last marker line per key."""
    marked = lines.filter(F.col("line").rlike(MARKER))
    return marked.groupBy(*keys).agg(
        F.max_by(F.regexp_extract("line", MARKER, 1), order).alias("run_dir")
    )


def tail(lines: DataFrame, order: str, n: int = 60) -> DataFrame:
    """The last n lines in their original order (a bounded top-n, no full sort)."""
    return lines.orderBy(F.desc(order)).limit(n).orderBy(order)


def next_version(used: DataFrame, day: str, version: str) -> DataFrame:
    """First unused version number per day, filling gaps.

    Candidates are 1 and every used number plus one. They meet the used numbers in
    one grouping, so no list of versions is built in one place.
    """
    kind = used.schema[version].dataType
    number = F.col(version)

    def entry(value, taken: bool):
        return F.struct(value.cast(kind).alias(version), F.lit(taken).alias("_taken"))

    marks = F.array(entry(number, True), entry(number + 1, False), entry(F.lit(1), False))
    return (
        used.select(day, F.inline(marks))
        .groupBy(day, version)
        .agg(F.bool_or("_taken").alias("_taken"))
        .filter(~F.col("_taken"))
        .groupBy(day)
        .agg(F.min(version).alias("next_version"))
    )

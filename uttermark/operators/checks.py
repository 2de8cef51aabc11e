"""Expectations over result tables and rendered reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


class ExpectationFailed(ValueError):
    pass


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, checked, violations) for all rules in one pass. NULL counts as violated."""
    names = list(rules)
    counts = df.agg(
        F.count(F.lit(1)).alias("_checked"),
        *[
            F.count(F.when(~F.coalesce(rules[n], F.lit(False)), 1)).alias(f"_{i}")
            for i, n in enumerate(names)
        ],
    )
    pairs = F.array(
        *[
            F.struct(F.lit(n).alias("rule"), F.col(f"_{i}").alias("violations"))
            for i, n in enumerate(names)
        ]
    )
    return counts.select("_checked", F.explode(pairs).alias("p")).select(
        F.col("p.rule").alias("rule"),
        F.col("_checked").alias("checked"),
        F.col("p.violations").alias("violations"),
    )


def expect(df: DataFrame, rules: Mapping[str, Column]) -> None:
    """Raise if any rule is violated; only one row per rule reaches the driver."""
    failed = [r for r in violations(df, rules).collect() if r["violations"] > 0]
    if failed:
        raise ExpectationFailed(", ".join(f"{r['rule']}: {r['violations']}" for r in failed))


def expect_report(
    text: str, *, required: Sequence[str] = (), banned: Sequence[str] = ()
) -> None:
    """A rendered report must hold all required and none of the banned passages."""
    for passage in banned:
        if passage in text:
            raise ExpectationFailed(f"banned passage in report: {passage!r}")
    for passage in required:
        if passage not in text:
            raise ExpectationFailed(f"passage missing in report: {passage!r}")

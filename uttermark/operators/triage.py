"""Finding files that need a look."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import grading as g
from .joins import join_null_safe
from .quantiles import exact_quantiles
from .rollup import metrics_long

TAIL_METRICS = {
    "cer_mean": "cer_tail",
    "cer_std": "std_tail",
    "high_severity_rate": "high_tail",
    "rtf_mean": "rtf_tail",
}


def tail_thresholds(file_grain: DataFrame, q: float = 0.85) -> DataFrame:
    """Per engine the q-quantile over its files of the four tail metrics."""
    long = metrics_long(file_grain, ["engine"], {m: F.col(m) for m in TAIL_METRICS})
    ranks = exact_quantiles(long, ["engine", "metric"], "value", {"threshold": q})
    return ranks.groupBy("engine").agg(
        *[
            F.max(F.when(F.col("metric") == m, F.col("threshold"))).alias(t)
            for m, t in TAIL_METRICS.items()
        ]
    )


def poor_cases(file_grain: DataFrame, q: float = 0.85) -> DataFrame:
    """Files with at least one trigger, their trigger list and its length.

    Files without a timed reference whose mean CER is 0 are no candidates. Thresholds
    and rows come from the same ``file_grain``, whose exchange Spark uses for both.
    """
    rows = join_null_safe(file_grain, tail_thresholds(file_grain, q), ["engine"]).filter(
        ~(~F.col("has_timestamp") & (F.coalesce("cer_mean", F.lit(0.0)) == 0))
    )
    c = F.col
    triggers = F.array_compact(
        F.array(
            F.when(c("cer_mean") >= 80, g.TRIGGER_CER),
            F.when(c("rtf_mean") >= 2.0, g.TRIGGER_RTF),
            F.when(c("high_severity_rate") > 0, g.TRIGGER_HIGH),
            F.when(c("cer_std") >= 10, g.TRIGGER_STD),
            F.when(c("tier_changes"), g.TRIGGER_TIER),
            F.when(c("cer_mean") >= c("cer_tail"), g.TRIGGER_TAIL_CER),
            F.when((c("cer_std") >= c("std_tail")) & (c("cer_std") > 0), g.TRIGGER_TAIL_STD),
            F.when(
                (c("high_severity_rate") >= c("high_tail")) & (c("high_severity_rate") > 0),
                g.TRIGGER_TAIL_HIGH,
            ),
            F.when(c("rtf_mean") >= c("rtf_tail"), g.TRIGGER_TAIL_RTF),
        )
    )
    return (
        rows.withColumn("triggers", triggers)
        .withColumn("n_triggers", F.size("triggers").cast("bigint"))
        .filter("n_triggers > 0")
    )


def worst_first() -> list:
    """Ordering of the triage list, with a tie key for a stable result."""
    return [
        F.desc("n_triggers"),
        F.desc("cer_mean"),
        F.desc("cer_std"),
        F.desc("high_severity_rate"),
        F.asc("engine"),
        F.asc("file"),
    ]


def top_per_engine(cases: DataFrame, n: int) -> DataFrame:
    """The n worst cases of each engine, with their ``place``. Spark keeps only the
    n first rows per engine and task before the exchange (window group limit)."""
    order = Window.partitionBy("engine").orderBy(*worst_first())
    return cases.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)

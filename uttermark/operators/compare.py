"""Comparing two runs, two histograms or two engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.grading import is_success
from .matching import last_wins


def compare_runs(left: DataFrame, right: DataFrame, order: str = "seq") -> DataFrame:
    """Full outer join by file; differences only where both sides succeeded."""

    def side(df: DataFrame, tag: str) -> DataFrame:
        ok = is_success(F.col("status"))
        last = last_wins(df.select("file", order, "status", "inference_rtf", "cer_bp"),
                         ["file"], order)
        return last.select(
            "file",
            F.when(ok, F.coalesce("inference_rtf", F.lit(0.0))).alias(f"{tag}_rtf"),
            F.when(ok, F.col("cer_bp") / 100).alias(f"{tag}_cer"),
        )

    return (
        side(left, "left")
        .join(side(right, "right"), "file", "full_outer")
        .withColumn("rtf_diff", F.col("left_rtf") - F.col("right_rtf"))
        .withColumn("cer_diff", F.col("left_cer") - F.col("right_cer"))
    )


def compare_histograms(left: DataFrame, right: DataFrame, label: str) -> DataFrame:
    """Counts per label on both sides, 0 where a side lacks the label."""

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy(label).agg(F.count(F.lit(1)).alias(tag))

    zero = F.lit(0).cast("bigint")
    return (
        side(left, "n_left")
        .join(side(right, "n_right"), label, "full_outer")
        .select(
            label,
            F.coalesce("n_left", zero).alias("n_left"),
            F.coalesce("n_right", zero).alias("n_right"),
        )
        .withColumn("diff", F.col("n_left") - F.col("n_right"))
    )


def side_by_side(file_grain: DataFrame, left: str, right: str) -> DataFrame:
    """Both engines' file statistics in one row, by conditional aggregation: one
    pass over the file grain where a self join would need two."""

    def of(engine: str, metric: str, name: str):
        return F.max(F.when(F.col("engine") == engine, F.col(metric))).alias(name)

    metrics = ("cer_mean", "rtf_mean", "hallucination_rate")
    return (
        file_grain.filter(F.col("engine").isin(left, right))
        .groupBy("file")
        .agg(
            *[of(left, m, f"left_{m}") for m in metrics],
            *[of(right, m, f"right_{m}") for m in metrics],
        )
    )

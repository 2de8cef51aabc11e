"""Exact percentiles by distributed selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from .joins import join_null_safe
from .scan import fine_bins


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: Mapping[str, float]
) -> DataFrame:
    """Linear-interpolation percentiles at position ``(n - 1) * q`` per key.

    Equal values collapse before the shuffle. Bin counts then tell which bin holds
    each wanted rank, and only those bins are sorted: no task ever holds a key.
    NULL and NaN are skipped; keys without any value give no row.
    """
    return quantiles_of_counts(value_counts(df, keys, value), keys, quantiles)


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, _v, _c): distinct values of a key with their counts, NULL and NaN skipped."""
    return (
        df.select(*keys, F.col(value).cast("double").alias("_v"))
        .filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
        .groupBy(*keys, "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )


def quantiles_of_counts(
    counts: DataFrame, keys: Sequence[str], quantiles: Mapping[str, float]
) -> DataFrame:
    """``exact_quantiles`` from counted distinct values (keys, _v, _c)."""
    counts = fine_bins(counts, keys, "_v")
    by_key = Window.partitionBy(*keys)
    bins = (
        counts.groupBy(*keys, "_bin")
        .agg(F.sum("_c").alias("_bc"))
        .select(
            *keys,
            "_bin",
            F.sum("_bc").over(by_key).alias("_n"),
            F.sum("_bc").over(by_key.orderBy("_bin")).alias("_end"),
            "_bc",
        )
        .withColumn("_start", F.col("_end") - F.col("_bc"))
    )

    def low(q: float):
        return F.floor((F.col("_n") - 1) * F.lit(q))

    def high(q: float):
        return F.ceil((F.col("_n") - 1) * F.lit(q))

    wanted = F.lit(False)
    for q in quantiles.values():
        for rank in (low(q), high(q)):
            wanted = wanted | ((rank >= F.col("_start")) & (rank < F.col("_end")))
    hit_bins = bins.filter(wanted).select(*keys, "_bin", "_n", "_start")

    in_bin = Window.partitionBy(*keys, "_bin").orderBy("_v")
    ranked = (
        join_null_safe(counts, hit_bins, [*keys, "_bin"])
        .withColumn("_stop", F.col("_start") + F.sum("_c").over(in_bin))
        .withColumn("_from", F.col("_stop") - F.col("_c"))
    )

    def value_at(rank):
        return F.max(F.when((rank >= F.col("_from")) & (rank < F.col("_stop")), F.col("_v")))

    picked = ranked.groupBy(*keys).agg(
        F.max("_n").alias("_n"),
        *[value_at(low(q)).alias(f"_lo_{n}") for n, q in quantiles.items()],
        *[value_at(high(q)).alias(f"_hi_{n}") for n, q in quantiles.items()],
    )
    return picked.select(
        *keys,
        *[
            (
                F.col(f"_lo_{n}")
                + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))
                * ((F.col("_n") - 1) * F.lit(q) - low(q))
            ).alias(n)
            for n, q in quantiles.items()
        ],
    )

"""Probability that a value of one side is below a value of the other side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .scan import fine_bins

COUNT = "decimal(19,0)"


def superiority(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    *,
    left: Column,
    right: Column,
    bins: str | None = None,
) -> DataFrame:
    """All left-right pairs per key compared with ``<``, without forming a pair.

    ``left`` and ``right`` are the weights of a row on either side (0 or 1 for
    plain data, draw counts for resampled data); rows of neither side are best
    filtered out before. Equal values are summed up first. The sorted
    window covers one bin of one key: there every right value meets the left weight
    below it. Only bin totals are then run through per key, without a join.
    NULL values are skipped. A key without one of the sides gives NULLs. ``bins`` names a
    column of ``scan.fine_bins`` where the caller has made them for other keys already.

    Result: keys, total_pairs, p_left (left < right), p_right, p_tie.
    """
    # A key-less call gets a constant key; it holds few bins, not the data.
    rows = df if keys else df.withColumn("_all", F.lit(0))
    by = list(keys) or ["_all"]
    weights = (
        rows.select(
            *by,
            F.col(value).cast("double").alias("_v"),
            *([F.col(bins).alias("_bin")] if bins else []),
            left.cast("bigint").alias("_l"),
            right.cast("bigint").alias("_r"),
        )
        .filter(F.col("_v").isNotNull())
        .groupBy(*by, "_v", *(["_bin"] if bins else []))
        .agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
        .filter((F.col("_l") != 0) | (F.col("_r") != 0))
    )
    if not bins:
        weights = fine_bins(weights, by, "_v")
    inside = Window.partitionBy(*by, "_bin").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, -1
    )
    below_in_bin = F.coalesce(F.sum("_l").over(inside), F.lit(0))
    sums = (
        weights.withColumn("_below", below_in_bin)
        .groupBy(*by, "_bin")
        .agg(
            F.sum("_l").cast(COUNT).alias("_bl"),
            F.sum("_r").cast(COUNT).alias("_br"),
            F.sum(F.col("_r").cast(COUNT) * F.col("_below").cast(COUNT)).alias("_wins"),
            F.sum(F.col("_r").cast(COUNT) * F.col("_l").cast(COUNT)).alias("_ties"),
        )
    )
    return of_bins(sums, keys, by)


def of_bins(bins: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The result of ``superiority`` from the sums of bins (``by``, _bin, _bl, _br, _wins,
    _ties): weights of both sides, pairs won by left values and ties inside each bin."""
    # A bin's right weight also beats all left weight of the lower bins of its key.
    lower = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    below_bin = F.coalesce(F.sum("_bl").over(lower), F.lit(0)).cast(COUNT)
    total = F.sum("_bl").cast(COUNT) * F.sum("_br").cast(COUNT)
    sums = (
        bins.withColumn("_wins", F.col("_wins") + F.col("_br") * below_bin)
        .groupBy(*by)
        .agg(
            total.cast("double").alias("total_pairs"),
            F.sum("_wins").cast("double").alias("_wins"),
            F.sum("_ties").cast("double").alias("_ties"),
        )
    )

    def share(part: Column) -> Column:
        return F.when(F.col("total_pairs") > 0, part / F.col("total_pairs"))

    return sums.select(
        *keys,
        "total_pairs",
        share(F.col("_wins")).alias("p_left"),
        share(F.col("total_pairs") - F.col("_wins") - F.col("_ties")).alias("p_right"),
        share(F.col("_ties")).alias("p_tie"),
    )

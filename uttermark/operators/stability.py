"""Do repeated runs agree?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def field_differences(df: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Number of distinct texts of each field per key; NULL is a value of its own.

    Distinct by grouping first: repeated values of a hot key collapse before the
    shuffle.
    """
    texts = df.select(*key, *[F.coalesce(F.col(f).cast("string"), F.lit("None")).alias(f)
                              for f in fields])
    return (
        texts.unpivot(list(key), list(fields), "field", "text")
        .distinct()
        .groupBy(*key, "field")
        .agg(F.count(F.lit(1)).alias("n_values"))
    )


def field_stability(df: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Per field how many keys are identical or different over their runs."""
    return (
        field_differences(df, key, fields)
        .groupBy("field")
        .agg(
            F.count(F.when(F.col("n_values") == 1, 1)).alias("identical_count"),
            F.count(F.when(F.col("n_values") > 1, 1)).alias("different_count"),
        )
        .withColumn(
            "status",
            F.when(F.col("different_count") == 0, "PERFECTLY STABLE").otherwise("VOLATILE"),
        )
    )


def conclusion(stability: DataFrame) -> DataFrame:
    return stability.agg(
        F.every(F.col("different_count") == 0).alias("completely_identical"),
        F.count(F.when(F.col("different_count") == 0, 1)).alias("stable_fields"),
        F.count(F.when(F.col("different_count") > 0, 1)).alias("volatile_fields"),
    )


def run_cells(
    df: DataFrame, keys: Sequence[str], run: str, cell: Column, order: str
) -> DataFrame:
    """(keys, run, cell) for every run there is; the last duplicate wins. What a wide table
    shows, in the form that needs no list of runs."""
    return df.groupBy(*keys, run).agg(F.max_by(cell, F.col(order)).alias("cell"))


def pivot_runs(
    df: DataFrame, keys: Sequence[str], run: str, runs: Sequence[str], cell: Column, order: str
) -> DataFrame:
    """One column per listed run; a missing cell shows ``-``, the last duplicate wins.

    The run list is fixed by the caller, so Spark needs no extra pass to find it.
    """
    cells = df.select(*keys, run, F.col(order).alias("_order"), cell.alias("_cell"))
    wide = cells.groupBy(*keys).pivot(run, list(runs)).agg(F.max_by("_cell", "_order"))
    return wide.select(*keys, *[F.coalesce(F.col(f"`{r}`"), F.lit("-")).alias(r) for r in runs])

"""Running computations that survive a key holding a third of all rows.

A plain ``Window.partitionBy(key)`` sorts a whole key in one task. Here the
sequence number cuts every key into blocks of at most ``block_rows`` rows (the
number is unique within its key, so the bound is proven). Each block is first
summarised, the small block summaries are scanned per key, and what flows into a
block is joined back, so that the row-level window only ever sees one block.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .joins import join_null_safe

BLOCK_ROWS = 1 << 18


def _in_blocks(df: DataFrame, keys: Sequence[str], seq: str, block_rows: int, *extra: Column) -> DataFrame:
    """``df`` with the ``extra`` columns, ``_key`` and ``_block``, dealt out by these two.

    Summaries and row windows both start from this exchange, and Spark runs it once: the
    row travels as one struct and is opened behind it, so neither reader can have the
    exchange pruned to columns of its own, which would be another exchange and another scan.
    As fields of a struct, NULL keys meet each other in joins too.
    """
    wide = df.select("*", *extra)
    return (
        wide.select(
            F.struct(*keys).alias("_key"),
            # Never NULL: Spark would push a filter that says so into one reader's exchange.
            F.coalesce(F.floor(F.col(seq) / block_rows), F.lit(0).cast("bigint")).alias("_block"),
            F.struct(*wide.columns).alias("_row"),
        )
        .repartition("_key", "_block")
        .select("_key", "_block", F.inline(F.array("_row")))
    )


def running(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    *,
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    totals: Mapping[str, Column] | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add running columns per ``keys`` in the order of the BIGINT ``seq``.

    ``sums``: running sum up to and including the row. ``lasts``: last non-NULL
    value among the rows strictly before it. ``totals``: sum over the whole key.
    NULL is a key like any other. The per-key scan meets ``range of seq / block_rows``
    blocks at most; take larger blocks where ``seq`` is sparse, such as a clock.
    """
    sums, lasts, totals = dict(sums or {}), dict(lasts or {}), dict(totals or {})
    group = ["_key", "_block"]
    rows = _in_blocks(
        df, keys, seq, block_rows,
        *[c.alias(f"_s_{n}") for n, c in sums.items()],
        *[c.alias(f"_l_{n}") for n, c in lasts.items()],
        *[c.alias(f"_t_{n}") for n, c in totals.items()],
    )

    block_totals = rows.groupBy(*group).agg(
        *[F.sum(f"_t_{n}").alias(f"_t_{n}") for n in totals],
        *[F.sum(f"_s_{n}").alias(f"_s_{n}") for n in sums],
        *[
            F.max_by(f"_l_{n}", F.when(F.col(f"_l_{n}").isNotNull(), F.col(seq))).alias(f"_l_{n}")
            for n in lasts
        ],
    )
    earlier = (
        Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    inflow = block_totals.select(
        *group,
        *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_in_{n}") for n in sums],
        *[F.last(f"_l_{n}", ignorenulls=True).over(earlier).alias(f"_in_{n}") for n in lasts],
        *[F.sum(f"_t_{n}").over(Window.partitionBy("_key")).alias(n) for n in totals],
    )

    inside = Window.partitionBy(*group).orderBy(seq)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(inflow, group).select(
        *[F.col(c) for c in df.columns if c not in sums and c not in lasts],
        *[
            (F.coalesce(F.sum(f"_s_{n}").over(upto), F.lit(0)) + F.col(f"_in_{n}")).alias(n)
            for n in sums
        ],
        *[
            F.coalesce(F.last(f"_l_{n}", ignorenulls=True).over(before), F.col(f"_in_{n}")).alias(n)
            for n in lasts
        ],
        *totals,
    )


def running_breaks(
    df: DataFrame, keys: Sequence[str], seq: str, value: str, begins: Callable[[Column, Column], Column],
    name: str, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``name``, the number of stretches of a key begun up to each row, in one pass.

    A row begins one where ``begins(value before, value)`` holds; the first row of a key
    always does. What happens at the edge of two blocks follows from their first and last
    values, which travel with the block summaries.
    """
    group = ["_key", "_block"]
    inside = Window.partitionBy(*group).orderBy(seq)
    before = F.lag(value).over(inside)
    first = F.row_number().over(inside) == 1
    rows = (
        _in_blocks(df, keys, seq, block_rows)
        .withColumn("_new", F.when(first, 0).when(begins(before, F.col(value)), 1).otherwise(0).cast("bigint"))
        .withColumn("_new", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    )
    blocks = rows.groupBy(*group).agg(
        F.min_by(value, seq).alias("_first"), F.max_by(value, seq).alias("_last"), F.max("_new").alias("_inner")
    )
    along = Window.partitionBy("_key").orderBy("_block")
    edge = F.when(F.row_number().over(along) == 1, 1).when(
        begins(F.lag("_last").over(along), F.col("_first")), 1
    ).otherwise(0).cast("bigint")
    inflow = blocks.withColumn("_edge", edge).select(
        *group,
        (
            F.coalesce(F.sum(F.col("_edge") + F.col("_inner")).over(
                along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_edge")
        ).alias("_begun"),
    )
    return rows.join(inflow, group).select(*df.columns, (F.col("_new") + F.col("_begun")).alias(name))


def row_position(
    df: DataFrame, keys: Sequence[str], seq: str, name: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """1-based position of a row within its key, in the order of ``seq``."""
    return running(df, keys, seq, sums={name: F.lit(1).cast("bigint")}, block_rows=block_rows)


BIN_ROWS = 1 << 16
CELLS = 1 << 12


def fine_bins(
    df: DataFrame, keys: Sequence[str], value: str, bin_rows: int = BIN_ROWS, levels: int = 2
) -> DataFrame:
    """Add ``_bin``, an order-preserving bin of the DOUBLE ``value`` within its key, fit for
    sorting one bin in one task.

    ``value_bin`` comes first. Where one of its bins holds more than ``bin_rows`` rows, such
    as a day of epoch microseconds or noise around a constant, it is cut into equal cells
    between its own smallest and largest value, and so once more; rows of one value stay
    together. Only the ranges of full bins are joined back.
    """
    names = [f"b{i}" for i in range(levels + 1)]
    zero = F.lit(0).cast("bigint")
    binned = df.withColumn(
        "_bin", F.struct(value_bin(F.col(value)).alias(names[0]), *[zero.alias(n) for n in names[1:]])
    )
    for level in names[1:]:
        full = (
            binned.groupBy(*keys, "_bin")
            .agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(F.lit(1)).alias("_rows"))
            .filter((F.col("_rows") > bin_rows) & (F.col("_lo") < F.col("_hi")))
            .drop("_rows")
        )
        place = (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
        cell = F.coalesce(F.least(F.floor(place * CELLS), F.lit(CELLS - 1)), zero)
        binned = join_null_safe(binned, full, [*keys, "_bin"], "left").select(
            *df.columns,
            F.struct(
                *[(cell if n == level else F.col(f"_bin.{n}")).alias(n) for n in names]
            ).alias("_bin"),
        )
    return binned


def value_bin(value: Column, per_e_fold: int = 256) -> Column:
    """Order-preserving bin of a DOUBLE, about 0.4 % of its magnitude wide.

    The bin depends on the value alone: no pass over the data, the same result in
    every task attempt, and a bounded number of bins per key.
    """
    size = F.floor(F.least(F.log1p(F.abs(value) * 1e6), F.lit(740.0)) * per_e_fold)
    return F.when(value < 0, -size).otherwise(size)

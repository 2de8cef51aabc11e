"""Reproducible bootstrap intervals.

Draws come from integer arithmetic on (seed, replicate, row), so they are equal on
every retry, on every cluster size and in any SQL engine. By default each row has a
Poisson(1) weight in each replicate, whatever the size of its group. Rows of one value are
told apart by nothing but their weights, so what is drawn is the weight of a value: a
value of more than ``FEW`` rows gets one draw of Poisson(rows), by its normal limit, and
one of fewer rows that many draws of Poisson(1). The cost follows the distinct values, and
sums combine before the shuffle. With ``method="rows"`` every row gets its own draw in
every replicate and the cost follows the rows; ``rowdraws`` then sums up where the draws
are made. ``method="draws"`` takes n draws with replacement from a group of n, which
gathers each group in an array.

A replicate in which all weights of a group are 0 has no mean and is left out of the
percentiles, so a single row gives (x, x).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import rowdraws
from .joins import join_null_safe
from .scan import fine_bins
from .superiority import of_bins, superiority

PRIME = 2147483647  # 2^31 - 1; products of two residues fit a BIGINT
REPLICAS = 2000
METHODS = ("poisson", "rows", "draws")

# Upper ends of the Poisson(1) distribution function, as shares of PRIME.
POISSON_STEPS = (
    0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462,
    0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253,
    0.999998874797402, 0.9999998885745216, 0.9999999899522336, 0.9999999991683892,
)


#: Up to so many equal values are drawn one by one. Beyond, Poisson and normal differ less
#: than 2000 replicates can tell, and a weight below 0 is rarer than one in 30,000.
FEW = 16
#: 2 pi to the last digit of a double, for both engines.
TURN = 6.283185307179586


def _fifth_power(x: Column) -> Column:
    square = (x * x) % PRIME
    return (((square * square) % PRIME) * x) % PRIME


def _with_draw(
    df: DataFrame, name: str, seed: int, rep: Column, row: Column, part: Column | None = None
) -> DataFrame:
    """Add a draw in [0, PRIME), and the one before it as ``_d1``. x -> x^5 permutes the
    residues, so two rounds mix well. ``part`` tells draws for one row apart."""
    start = ((rep + 1) * 1000003 + F.lit(seed).cast("bigint") * 7919) % PRIME
    start = (start * 48271 + (row % PRIME) * 69621 + 11) % PRIME
    if part is not None:
        start = (start + part * 40692) % PRIME
    return (
        df.withColumn("_d0", start)
        .withColumn("_d1", (_fifth_power(F.col("_d0")) + (row % PRIME) * 16807 + 101) % PRIME)
        .withColumn(name, _fifth_power(F.col("_d1")))
        .drop("_d0")
    )


def _starts(seed: int, replicas: int) -> list[int]:
    """What a draw starts from besides its row, for each replicate."""
    return [((rep + 1) * 1000003 + seed * 7919) % PRIME * 48271 for rep in range(replicas)]


def _steps() -> list[int]:
    return [int(step * PRIME) for step in POISSON_STEPS]


def poisson_weight(draw: Column) -> Column:
    weight = F.lit(0)
    for step in POISSON_STEPS:
        weight = weight + F.when(draw >= int(step * PRIME), 1).otherwise(0)
    return weight.cast("bigint")


def many_weight(rows: Column, first: Column, second: Column) -> Column:
    """Poisson(rows) by its normal limit; two draws give a normal one (Box and Muller)."""
    normal = F.sqrt(F.ln((first + 1) / (PRIME + 1.0)) * -2.0) * F.cos(second / float(PRIME) * TURN)
    return F.greatest(F.floor(rows + F.sqrt(rows.cast("double")) * normal + 0.5), F.lit(0)).cast("bigint")


def _sealed(draws: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hand the drawn columns on through a one-row generator. Filters on them (such
    as IS NOT NULL) then stay above it instead of being pushed down, where each
    would repeat the whole draw arithmetic."""
    return draws.select(*keys, "rep", F.inline(F.array(F.struct("value", "weight"))))


def resample(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    row_id: str,
    *,
    seed: int,
    replicas: int = REPLICAS,
    method: str = "poisson",
) -> DataFrame:
    """Resampled rows (keys, rep, value, weight), NULL values skipped.

    ``row_id`` is a BIGINT that orders the rows of a key and is unique within it.
    Needs at least one key column.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    rows = df.select(
        *keys, F.col(value).cast("double").alias("value"), F.col(row_id).alias("_row")
    ).filter(F.col("value").isNotNull())
    last = F.lit(replicas - 1).cast("bigint")
    reps = F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("rep")
    if method == "rows":
        weighted = _with_draw(
            rows.repartition("_row").select("*", reps), "_draw", seed, F.col("rep"), F.col("_row")
        )
        weight = poisson_weight(F.col("_draw"))
        return _sealed(weighted.select(*keys, "rep", "value", weight.alias("weight")), keys)
    if method == "poisson":
        values = rows.groupBy(*keys, "value").agg(
            F.count(F.lit(1)).alias("_rows"), F.min("_row").alias("_row")
        )
        many = F.col("_rows") > FEW
        parts = F.when(many, F.lit(0)).otherwise(F.col("_rows") - 1).cast("bigint")
        atoms = values.select(
            *keys, "value", "_row", F.when(many, F.col("_rows")).otherwise(1).alias("_rows"),
            F.explode(F.sequence(F.lit(0).cast("bigint"), parts)).alias("_part"),
        )
        # Few small rows, but each is drawn for `replicas` times: they are dealt out to all
        # tasks by a number that AQE leaves alone, whatever the key.
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        weighted = _with_draw(
            atoms.repartition(tasks, "_row", "_part").select("*", reps),
            "_draw", seed, F.col("rep"), F.col("_row"), F.col("_part"),
        )
        weight = F.when(
            F.col("_rows") > 1, many_weight(F.col("_rows"), F.col("_d1"), F.col("_draw"))
        ).otherwise(poisson_weight(F.col("_draw")))
        return _sealed(weighted.select(*keys, "rep", "value", weight.alias("weight")), keys)
    groups = (
        rows.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("_row", "value"))).alias("_rows"))
        .select(*keys, F.col("_rows.value").alias("_values"))
        .withColumn("_n", F.size("_values").cast("bigint"))
    )
    places = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).alias("_pos")
    drawn = groups.select(*keys, "_values", "_n", reps).select("*", places)
    drawn = _with_draw(drawn, "_draw", seed, F.col("rep"), F.col("_pos"))
    return _sealed(
        drawn.select(
            *keys,
            "rep",
            F.get(F.col("_values"), (F.col("_draw") % F.col("_n")).cast("int")).alias("value"),
            F.lit(1).cast("bigint").alias("weight"),
        ),
        keys,
    )


def bootstrap_mean(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    row_id: str,
    *,
    seed: int,
    replicas: int = REPLICAS,
    method: str = "poisson",
) -> DataFrame:
    """95 % interval of the mean per key: (keys, ci_low, ci_high)."""
    if method == "rows":
        sums = rowdraws.weighted_sums(
            df, keys, value, row_id, steps=_steps(), starts=_starts(seed, replicas)
        )
    else:
        draws = resample(
            df, keys, value, row_id, seed=seed, replicas=replicas, method=method
        )
        sums = draws.select(*keys, "rep", (F.col("value") * F.col("weight")).alias("_sum"), "weight")
    means = sums.groupBy(*keys, "rep").agg(
        F.try_divide(F.sum("_sum"), F.sum("weight")).alias("_m")
    )
    # At most `replicas` means per key, so the built-in percentile is bounded.
    return means.groupBy(*keys).agg(
        F.percentile("_m", 0.025).alias("ci_low"), F.percentile("_m", 0.975).alias("ci_high")
    )


def bootstrap_superiority(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    row_id: str,
    *,
    side: str,
    left: str,
    right: str,
    seed: int,
    replicas: int = REPLICAS,
    method: str = "poisson",
) -> DataFrame:
    """95 % interval of P(right < left) per key, both sides resampled."""
    both = df.filter(F.col(side).isin(left, right) & F.col(value).isNotNull())
    if method == "rows":
        return _superiority_of_rows(both, keys, value, row_id, F.col(side) == left, seed, replicas)
    group, bins = [*keys, side], None
    if method == "poisson":
        # Weights only thin out the values, so bins of the plain rows serve all replicates.
        slim = both.select(*group, F.col(value).cast("double").alias("_v"), F.col(row_id).alias("_id"))
        both, value, row_id, bins = fine_bins(slim, keys, "_v"), "_v", "_id", "_bin"
        group = [*group, bins]
    draws = resample(both, group, value, row_id, seed=seed, replicas=replicas, method=method)
    per_rep = superiority(
        draws,
        [*keys, "rep"],
        "value",
        left=F.when(F.col(side) == left, F.col("weight")).otherwise(0),
        right=F.when(F.col(side) == right, F.col("weight")).otherwise(0),
        bins=bins,
    )
    aggregates = (
        F.percentile("p_right", 0.025).alias("ci_low"),
        F.percentile("p_right", 0.975).alias("ci_high"),
    )
    return per_rep.groupBy(*keys).agg(*aggregates).filter(F.col("ci_low").isNotNull())


#: Rows of a key that one task draws for and compares; a larger key is cut by value.
PART_ROWS = 1 << 16


def _superiority_of_rows(
    both: DataFrame, keys: Sequence[str], value: str, row_id: str, is_left: Column, seed: int,
    replicas: int, part_rows: int = PART_ROWS,
) -> DataFrame:
    """Every row of a key meets its draws in the task that holds the key, so that plain rows
    are all that is moved. A key of more than ``part_rows`` rows is cut into ranges of values,
    and sums of its ranges are added up for each replicate."""
    by = list(keys) or ["_all"]
    rows = both.select(
        *(keys or [F.lit(0).alias("_all")]),
        F.col(value).cast("double").alias("_v"), is_left.alias("_is_left"), F.col(row_id).alias("_row"),
    )
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > part_rows)
    draws = {"steps": _steps(), "starts": _starts(seed, replicas)}
    small = rowdraws.key_intervals(join_null_safe(rows, sizes, by, "left_anti"), by, **draws)

    fine = fine_bins(join_null_safe(rows, sizes.drop("_rows"), by), by, "_v", part_rows)
    before = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    ranges = fine.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("_rows")).select(
        *by, "_bin",
        F.floor(F.coalesce(F.sum("_rows").over(before), F.lit(0)) / part_rows).alias("_part"),
    )
    ranged = join_null_safe(fine, ranges, [*by, "_bin"]).drop("_bin")
    per_rep = of_bins(rowdraws.part_sums(ranged, by, **draws), [*by, "rep"], [*by, "rep"])
    large = per_rep.groupBy(*by).agg(
        F.percentile("p_right", 0.025).alias("ci_low"), F.percentile("p_right", 0.975).alias("ci_high")
    )
    found = small.unionByName(large).filter(F.col("ci_low").isNotNull())
    return found.select(*keys, "ci_low", "ci_high")

"""Poisson(1) weights of every row in every replicate, summed up where they are drawn.

``bootstrap.resample`` gives each row and replicate as a row of its own, which is more than
can be moved or kept. Here Spark deals out and sorts the plain rows, and a task draws the
weights of a few of them at a time as arrays over all replicates. The draws are those of
``bootstrap``: the same integer arithmetic, where a residue modulo 2^31 - 1 is folded by
shift and mask. A row without a number has no weight, one below 0 the draw it has there.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby

from pyspark.sql import DataFrame, functions as F

PRIME = 2147483647
#: Rows drawn at a time; arrays of so many rows and 2000 replicates stay in a core's cache.
BLOCK = 16


class _Draws:
    """Weights (rows x replicates) of a block of row numbers, in arrays that are used again."""

    def __init__(self, steps: Sequence[int], starts: Sequence[int]):
        import numpy as np

        self.np, self.steps = np, steps
        self.starts = np.array(starts, dtype=np.uint64)
        shape = (BLOCK, len(starts))
        self.wide = [np.empty(shape, np.uint64) for _ in range(3)]
        self.draw, self.hit = np.empty(shape, np.uint32), np.empty(shape, bool)
        self.weight, self.real = np.empty(shape, np.uint8), np.empty(shape)

    def _fold(self, x, spare) -> None:
        np = self.np
        np.right_shift(x, 31, out=spare)
        np.bitwise_and(x, PRIME, out=x)
        np.add(x, spare, out=x)

    def _fifth_power(self, x, y, spare) -> None:
        """x below 2^31 + 2^18 becomes a number of the same residue, of at most 2^31 + 1."""
        for left, right, out in ((x, x, y), (y, y, y), (y, x, x)):
            self.np.multiply(left, right, out=out)
            self._fold(out, spare)
            self._fold(out, spare)

    def __call__(self, numbers):
        """``numbers``: at most BLOCK of them. The result is overwritten by the next call."""
        np, n = self.np, len(numbers)
        rows = np.fmod(numbers, PRIME)
        if n and rows.min() < 0:
            return self._signed(rows)
        x, y, spare = (a[:n] for a in self.wide)
        draw, hit, weight = self.draw[:n], self.hit[:n], self.weight[:n]
        np.add((rows * 69621 + 11).astype(np.uint64)[:, None], self.starts, out=x)
        self._fold(x, spare)
        self._fifth_power(x, y, spare)
        np.add(x, (rows * 16807 + 101).astype(np.uint64)[:, None], out=x)
        self._fold(x, spare)
        self._fifth_power(x, y, spare)
        np.copyto(draw, x, casting="unsafe")
        np.greater_equal(draw, PRIME, out=hit)
        if hit.any():
            draw[hit] -= PRIME
        return self._weights(draw, hit, weight)

    def _weights(self, draw, hit, weight):
        np, top = self.np, draw.max(initial=0)
        np.greater_equal(draw, self.steps[0], out=weight.view(bool))
        for step in self.steps[1:]:
            if top < step:
                break
            np.greater_equal(draw, step, out=hit)
            np.add(weight, hit.view(np.uint8), out=weight)
        return weight

    def _signed(self, rows):
        """With row numbers below 0: remainders with the sign of the dividend."""
        np, n = self.np, len(rows)

        def fifth_power(x):
            square = np.fmod(x * x, PRIME)
            return np.fmod(np.fmod(square * square, PRIME) * x, PRIME)

        starts = self.starts.astype(np.int64)
        x = fifth_power(np.fmod(rows[:, None] * 69621 + 11 + starts, PRIME))
        x = fifth_power(np.fmod(x + (rows * 16807 + 101)[:, None], PRIME))
        return self._weights(x, self.hit[:n], self.weight[:n])

    def of(self, numbers, known) -> Iterator[tuple[int, int, object]]:
        """(from, to, weights as BIGINT) block by block; rows that are not ``known`` weigh 0."""
        for at in range(0, len(numbers), BLOCK):
            to = min(at + BLOCK, len(numbers))
            weight = self(numbers[at:to])
            weight[~known[at:to]] = 0
            yield at, to, weight


def _runs(batches, keys: Sequence[str], columns: Sequence[str]):
    """(key, columns as arrays) of each stretch of one key in each batch, in their order."""
    for batch in batches:
        key = zip(*[batch.column(k).to_pylist() for k in keys], strict=True)
        arrays = [batch.column(c) for c in columns]
        at = 0
        for one, rows in groupby(key):
            n = sum(1 for _ in rows)
            yield one, [a.slice(at, n) for a in arrays]
            at += n


def _numbers(column):
    """Row numbers, and which of them are known."""
    import pyarrow.compute as pc

    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False), pc.is_valid(column).to_numpy(zero_copy_only=False)


def _batch(schema, keys, key, **arrays):
    """The key of all rows beside arrays of one length."""
    import pyarrow as pa

    n = len(next(iter(arrays.values())))
    fields = [pa.array([v] * n, schema.field(k).type) for k, v in zip(keys, key, strict=True)]
    fields += [pa.array(arrays[f.name], f.type) for f in schema if f.name in arrays]
    return pa.RecordBatch.from_arrays(fields, schema=schema)


def _dealt(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` by ``by``, sorted. Small rows take long to draw for, so their number of tasks
    is one that AQE leaves alone."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, *by).sortWithinPartitions(*order)


def _map(rows: DataFrame, function, keys: Sequence[str], fields: str) -> DataFrame:
    """``function(batches, schema)`` over the partitions of ``rows``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    made = StructType([rows.schema[k] for k in keys] + StructType.fromDDL(fields).fields)
    schema = to_arrow_schema(made)
    return rows.mapInArrow(lambda batches: function(batches, schema), made)


def weighted_sums(
    df: DataFrame, keys: Sequence[str], value: str, row_id: str, *, steps: Sequence[int], starts: Sequence[int]
) -> DataFrame:
    """(keys, rep, _sum, weight): sums of value * weight and of weight for each replicate, one
    row for each key, replicate and task. NULL values are skipped."""
    keys = list(keys)
    # Rows are spread by their number: a hot key keeps all tasks busy.
    rows = df.select(
        *keys, F.col(value).cast("double").alias("_v"), F.col(row_id).cast("bigint").alias("_row")
    ).filter(F.col("_v").isNotNull())
    rows = _dealt(rows, ["_row"], keys)

    def sums(batches, schema):
        import numpy as np

        draws, replicas = _Draws(steps, starts), np.arange(len(starts))
        for key, runs in groupby(_runs(batches, keys, ("_v", "_row")), lambda run: run[0]):
            total, weights = np.zeros(len(starts)), np.zeros(len(starts), np.int64)
            for _, (values, column) in runs:
                v, (numbers, known) = values.to_numpy(zero_copy_only=False), _numbers(column)
                for at, to, weight in draws.of(numbers, known):
                    real = draws.real[: to - at]
                    np.copyto(real, weight)
                    total += v[at:to] @ real
                    weights += weight.sum(axis=0, dtype=np.int64)
            yield _batch(schema, keys, key, rep=replicas, _sum=total, weight=weights)

    return _map(rows, sums, keys, "rep bigint, _sum double, weight bigint")


def _compare(np, draws, runs, columns: int):
    """(left weight, right weight, pairs won by left, ties) for each replicate, of rows in the
    order of their values that come in ``runs``."""
    left, right, wins, ties, same_left, same_right = (np.zeros(columns, np.int64) for _ in range(6))

    def close():
        """The rows of one value are all known: they meet the left weight below them."""
        nonlocal left, right, wins, ties
        wins += same_right * left
        ties += same_right * same_left
        left += same_left
        right += same_right
        same_left[:] = 0
        same_right[:] = 0

    last = None
    for _, (values, sides, column) in runs:
        v, (numbers, known) = values.to_numpy(zero_copy_only=False), _numbers(column)
        is_left = sides.to_numpy(zero_copy_only=False)
        for at, to, weight in draws.of(numbers, known):
            for i in range(at, to):
                if last is not None and v[i] != last and not (v[i] != v[i] and last != last):
                    close()
                last = v[i]
                same = same_left if is_left[i] else same_right
                np.add(same, weight[i - at], out=same)
    close()
    return left, right, wins, ties


def _quantile(np, values, share: float) -> float:
    """As Spark's percentile: linear between the two nearest of the sorted values."""
    place = (len(values) - 1) * share
    low, high = int(np.floor(place)), int(np.ceil(place))
    if low == high or values[low] == values[high]:
        return float(values[low])
    return float((high - place) * values[low] + (place - low) * values[high])


def key_intervals(
    rows: DataFrame, keys: Sequence[str], *, steps: Sequence[int], starts: Sequence[int]
) -> DataFrame:
    """(keys, ci_low, ci_high): the 95 % interval of P(right < left) of each key, out of
    (keys, _v, _is_left, _row). A task holds its keys whole, and one of them in turn takes
    a few arrays over the replicates."""
    keys = list(keys)
    dealt = rows.select(*keys, "_v", "_is_left", F.col("_row").cast("bigint").alias("_row"))
    dealt = _dealt(dealt, keys, [*keys, "_v"])

    def intervals(batches, schema):
        import numpy as np

        draws = _Draws(steps, starts)
        for key, runs in groupby(_runs(batches, keys, ("_v", "_is_left", "_row")), lambda run: run[0]):
            left, right, wins, ties = _compare(np, draws, runs, len(starts))
            pairs = left.astype(float) * right
            met = pairs > 0
            if met.any():
                p = np.sort((pairs - wins - ties)[met] / pairs[met])
                yield _batch(
                    schema, keys, key, ci_low=[_quantile(np, p, 0.025)], ci_high=[_quantile(np, p, 0.975)]
                )

    return _map(dealt, intervals, keys, "ci_low double, ci_high double")


def part_sums(
    rows: DataFrame, keys: Sequence[str], *, steps: Sequence[int], starts: Sequence[int]
) -> DataFrame:
    """(keys, _bin, rep, _bl, _br, _wins, _ties): what ``superiority.of_bins`` adds up, of each
    part of a key, out of (keys, _part, _v, _is_left, _row)."""
    keys = [*keys, "_bin"]
    dealt = rows.select(
        *keys[:-1], F.col("_part").cast("bigint").alias("_bin"), "_v", "_is_left",
        F.col("_row").cast("bigint").alias("_row"),
    )
    dealt = _dealt(dealt, keys, [*keys, "_v"])

    def sums(batches, schema):
        import numpy as np

        draws, replicas = _Draws(steps, starts), np.arange(len(starts))
        for key, runs in groupby(_runs(batches, keys, ("_v", "_is_left", "_row")), lambda run: run[0]):
            left, right, wins, ties = _compare(np, draws, runs, len(starts))
            yield _batch(schema, keys, key, rep=replicas, _bl=left, _br=right, _wins=wins, _ties=ties)

    found = _map(dealt, sums, keys, "rep bigint, _bl bigint, _br bigint, _wins bigint, _ties bigint")
    return found.withColumns({c: F.col(c).cast("decimal(19,0)") for c in ("_bl", "_br", "_wins", "_ties")})

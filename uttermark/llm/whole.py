"""Vectors of whole numbers, their exact products, and blocks of queries against rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import broadcast_if_small

#: Vectors of this norm or more take no part: multiples of their products leave 64 bits.
NORM = float(1 << 28)
EXACT = float(1 << 53)


def usable(column: str):
    """Neither null nor with a null or non-finite component."""
    return F.col(column).isNotNull() & ~F.coalesce(
        F.expr(f"exists({column}, x -> x IS NULL OR isnan(x) OR abs(x) = 'Infinity')"), F.lit(False)
    )


def _whole(scale: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(width)
            lengths = np.array([len(v) for v in lists], np.int64)
            for length in np.unique(lengths):
                part = batch.filter(pa.array(lengths == length))
                with np.errstate(over="ignore"):
                    flat = np.floor(np.asarray(part.column(width).flatten(), np.float64) * scale)
                    vectors = flat.reshape(part.num_rows, length)
                    fits = np.sqrt((vectors * vectors).sum(axis=1)) < NORM
                part = part.filter(pa.array(fits))
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:width],
                        pa.array(np.full(part.num_rows, length, np.int32)),
                        pa.array([v.tobytes() for v in vectors[fits]], pa.binary()),
                    ],
                    names=[*part.schema.names[:width], "length", "vector"],
                )

    return run


def whole_vectors(rows: DataFrame, scale: int) -> DataFrame:
    """``rows`` (.., embedding) with floor(scale * x) of each component, as ``length`` and
    ``vector``, the bytes of doubles that hold whole numbers."""
    names = [c for c in rows.columns if c != "embedding"]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    slim = rows.filter(usable("embedding")).select(
        *names, F.col("embedding").cast("array<double>").alias("embedding")
    )
    return slim.mapInArrow(_whole(scale, len(names)), f"{kinds}, length int, vector binary")


def matrix(group: pa.Table) -> np.ndarray:
    vectors = group.column("vector").to_pylist()
    length = group.column("length")[0].as_py() if vectors else 0
    return np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), length)


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows: of doubles while they hold them, else of integers."""
    norms = [np.sqrt((m * m).sum(axis=1).max(initial=0)) for m in (left, right)]
    if norms[0] * norms[1] < EXACT:
        return left @ right.T
    return left.astype(np.int64) @ right.astype(np.int64).T


def lowest(scores: np.ndarray):
    return -np.inf if scores.dtype.kind == "f" else np.iinfo(np.int64).min


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the ``k`` highest scores of each row, the first column of
    equal ones first; cells of the lowest value are none. ``scores`` is used up."""
    none, found = lowest(scores), []
    every = np.arange(len(scores))
    for _ in range(min(k, scores.shape[1])):
        column = scores.argmax(axis=1)
        value = scores[every, column]
        there = value > none
        if not there.any():
            break
        found.append((every[there], column[there], value[there].astype(np.int64)))
        scores[every, column] = none
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(part) for part in zip(*found))


def fresh(df: DataFrame) -> DataFrame:
    """The same columns under identities of their own, so that a table can be cogrouped
    with one it was derived from."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def in_blocks(
    queries: DataFrame, rows: DataFrame, on: Sequence[str], fn: Callable, schema: str,
    part: int, chunk: int,
) -> DataFrame:
    """``fn(queries, rows)`` for every chunk of about ``chunk`` queries and every part of
    about ``part`` rows that are equal in the columns ``on``. Both have a unique ``uid``. A
    query is sent once for each part, a row once for each chunk; a key of any size is cut."""

    def pieces(df: DataFrame, size: int, name: str) -> DataFrame:
        counts = df.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / size).alias(name))
        return counts.select(*[F.col(c).alias(f"_{c}") for c in on], name)

    sizes = pieces(queries, chunk, "_chunks").join(
        pieces(rows, part, "_parts"), [f"_{c}" for c in on]
    )
    sizes = broadcast_if_small(sizes)

    def cut(df: DataFrame, own: str, other: str) -> DataFrame:
        joined = df.join(sizes, [F.col(c) == F.col(f"_{c}") for c in on])
        return joined.select(
            *df.columns,
            F.pmod(F.xxhash64("uid"), f"_{own}s").alias(f"_{own}"),
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"_{other}s") - 1)).alias(f"_{other}"),
        )

    keys = [*on, "_part", "_chunk"]
    return (
        fresh(cut(queries, "chunk", "part"))
        .groupBy(*keys)
        .cogroup(cut(rows, "part", "chunk").groupBy(*keys))
        .applyInArrow(fn, schema)
    )

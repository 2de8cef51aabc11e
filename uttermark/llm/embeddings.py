"""Near-duplicate vectors: random-hyperplane sign hashing in several tables.

Equal vectors of one label are one class from the start. Classes of a label that share
the signs of all hyperplanes of some table are compared by exact cosine, in blocks of
bounded size: a bucket of any size is cut into parts, and each pair of parts is one group.
There are as many hyperplanes as keep vectors of the largest label from meeting by chance
and as many tables as linked ones need to meet, so work grows little faster than the rows.
Groups pass through a task one after the other, small ones many at a time.
A large group gives back one row per vector, not its pairs: the number of vectors linked,
and a neighbour that spans the group's links. A pair that meets in several tables is counted
where it meets first, which both vectors tell by themselves; signs are computed on whole
numbers that doubles hold exactly, so they are the same wherever they are computed.

Defined cases: a vector that is null, empty, zero or holds null or non-finite components,
or whose label or id is null, links with nothing. Vectors of different lengths are never
compared. Repeated rows count as vectors of their own. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import components, table, written
from .registry import query

BITS, SPARE_BITS = 12, 3
MISS = 1e-6
PART = 1024
SMALL = 16
SCALE = 1 << 24


def table_count(threshold: float, bits: int = BITS, miss: float = MISS) -> int:
    """Tables after which a pair exactly at the threshold has met with chance 1 - miss."""
    agree = 1 - math.acos(threshold) / math.pi
    return math.ceil(math.log(miss) / math.log1p(-(agree**bits)))


def bit_count(largest: int) -> int:
    """Hyperplanes of a table: so many that the largest label has an eighth of a vector for each
    bucket, and chance meetings stay few."""
    return max(BITS, math.ceil(math.log2(max(largest, 1))) + SPARE_BITS)


@functools.lru_cache(maxsize=8)
def planes(length: int, tables: int, bits: int) -> np.ndarray:
    drawn = np.random.default_rng([length, tables, bits]).standard_normal((length, tables * bits))
    return np.rint(drawn * 256)


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def codes(units: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """(vector, table) -> signs as a number. Products and sums stay far below 2^53."""
    sides = np.rint(units * SCALE) @ planes(units.shape[1], tables, bits) >= 0
    weights = 1 << np.arange(bits, dtype=np.int64)
    return sides.reshape(len(units), tables, bits) @ weights


def _vectors(column: pa.Array, length: int) -> np.ndarray:
    return np.stack([np.frombuffer(v.as_buffer(), np.float64) for v in column]).reshape(-1, length)


def _hash(tables: int, bits: int):
    """(node, weight, space, vector) -> node, weight, space, bytes of the vector, codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                lists = batch.column(3)
                lengths = np.array([len(v) for v in lists])
                for length in np.unique(lengths):
                    part = batch.filter(pa.array(lengths == length))
                    vectors = np.array(part.column(3).flatten(), np.float64).reshape(-1, length)
                    found = codes(unit(vectors), tables, bits)
                    offsets = np.arange(len(found) + 1, dtype=np.int32) * tables
                    yield pa.RecordBatch.from_arrays(
                        [
                            *part.columns[:3],
                            pa.array([v.tobytes() for v in vectors], pa.binary()),
                            pa.ListArray.from_arrays(offsets, found.ravel()),
                        ],
                        names=["node", "weight", "space", "vector", "codes"],
                    )

    return run


def group_links(
    nodes: np.ndarray, weights: np.ndarray, vectors: np.ndarray, side: np.ndarray,
    crossed: bool, at: int, threshold: float, tables: int, bits: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes with links that table ``at`` counts, the linked weight of each, a root."""
    units = unit(vectors)
    rows = np.flatnonzero(side == 0)
    cols = np.flatnonzero(side == 1) if crossed else rows
    close = units[rows] @ units[cols].T >= threshold
    if not crossed:
        np.fill_diagonal(close, False)
    x, y = np.nonzero(close)
    used = np.union1d(rows[x], cols[y])
    if len(used):
        place = np.empty(len(nodes), np.int64)
        place[used] = np.arange(len(used))
        sign = codes(units[used], tables, bits)
        for i in range(0, len(x), 1 << 16):
            a, b = sign[place[rows[x[i : i + 65536]]]], sign[place[cols[y[i : i + 65536]]]]
            late = (a == b).argmax(axis=1) != at
            close[x[i : i + 65536][late], y[i : i + 65536][late]] = False
    linked = np.zeros(len(nodes), np.int64)
    linked[rows] += close @ weights[cols]
    if crossed:
        linked[cols] += weights[rows] @ close
    root = nodes.copy()
    while True:
        before = root.copy()
        top = np.iinfo(np.int64).max
        for ours, others, link in ((rows, cols, close), (cols, rows, close.T)):
            best = np.where(link, root[others], top).min(axis=1, initial=top)
            root[ours] = np.minimum(root[ours], best)
        if (before == root).all():
            break
    found = linked > 0
    return nodes[found], linked[found], root[found]


def small_links(
    nodes: np.ndarray, weights: np.ndarray, units: np.ndarray, starts: np.ndarray, sizes: np.ndarray,
    at: np.ndarray, threshold: float, tables: int, bits: int,
) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """As ``group_links`` for many small groups at once: two rows for each pair linked."""
    out = []
    for size in np.unique(sizes):
        first, second = np.triu_indices(size, 1)
        begin = starts[sizes == size]
        step = max(1, (1 << 15) // len(first))
        for part in range(0, len(begin), step):
            rows = begin[part : part + step, None]
            x, y = (rows + first).ravel(), (rows + second).ravel()
            close = np.einsum("ij,ij->i", units[x], units[y]) >= threshold
            x, y = x[close], y[close]
            if len(x):
                same = codes(units[x], tables, bits) == codes(units[y], tables, bits)
                early = same.argmax(axis=1) == at[x]
                x, y = x[early], y[early]
                root = np.minimum(nodes[x], nodes[y])
                out += [(nodes[x], weights[y], root), (nodes[y], weights[x], root)]
    return out


LINK = ["node", "links", "root"]
PLACE = ["space", "t", "code", "i", "j"]


def _edges(table: pa.Table) -> np.ndarray:
    """Rows at which a group begins, and the end; rows come sorted by group."""
    changed = np.zeros(table.num_rows, bool)
    changed[:1] = True
    for name in PLACE:
        column = table.column(name).combine_chunks()
        if name == "space":
            column = column.dictionary_encode().indices
        values = column.to_numpy(zero_copy_only=False)
        changed[1:] |= values[1:] != values[:-1]
    return np.append(np.flatnonzero(changed), table.num_rows)


def _compare(threshold: float, tables: int, bits: int):
    """Links of whole groups; what follows the last edge of a batch waits for the next."""

    def links(table: pa.Table, edges: np.ndarray) -> Iterator[tuple]:
        get = lambda name: table.column(name).combine_chunks()
        nodes, weights, at = (get(n).to_numpy() for n in ("node", "weight", "t"))
        i, j, part, vectors = get("i").to_numpy(), get("j").to_numpy(), get("part").to_numpy(), get("vector")
        starts, sizes = edges[:-1], np.diff(edges)
        small = (i[starts] == j[starts]) & (sizes <= SMALL)
        # Vectors of one group have one length; those of a batch mostly have.
        length = np.array([len(v.as_buffer()) for v in vectors], np.int64) // 8
        for n in np.unique(length[starts[small]]):
            groups = np.flatnonzero(small & (length[starts] == n))
            rows = np.concatenate([np.arange(starts[g], edges[g + 1]) for g in groups])
            units = unit(_vectors(vectors.take(pa.array(rows)), n))
            begin = np.cumsum(sizes[groups]) - sizes[groups]
            yield from small_links(
                nodes[rows], weights[rows], units, begin, sizes[groups], at[rows], threshold, tables, bits
            )
        for g in np.flatnonzero(~small):
            rows = slice(starts[g], edges[g + 1])
            first, second = i[starts[g]], j[starts[g]]
            yield group_links(
                nodes[rows], weights[rows], _vectors(vectors[rows], length[starts[g]]),
                (part[rows] != first).astype(np.int64), first != second, at[starts[g]],
                threshold, tables, bits,
            )

    def found(table: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        for columns in links(table, edges):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=LINK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            whole = pa.Table.from_batches([batch])
            whole = whole if rest is None else pa.concat_tables([rest, whole])
            edges = _edges(whole)
            if len(edges) > 2:
                yield from found(whole.slice(0, edges[-2]), edges[:-1])
                whole = whole.slice(edges[-2])
            rest = whole
        if rest is not None and rest.num_rows:
            yield from found(rest, np.array([0, rest.num_rows]))

    return run


def vector_links(
    vectors: DataFrame, threshold: float = 0.93, bits: int | None = None, part: int = PART
) -> DataFrame:
    """Links between ``vectors`` (vec_id, embedding, label) of equal label.

    ``bits`` follows from the size of the largest label (``bit_count``) unless given.
    Returns one row per row: vec_id, n_links, component_id, kept.
    """
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.concat_ws(":", F.size("embedding"), F.col("label").cast("string")).alias("space"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        (
            F.col("vec_id").isNotNull()
            & F.col("label").isNotNull()
            & F.expr("exists(embedding, x -> x <> 0)")
            & ~F.expr("exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = 'Infinity')")
        ).alias("valid"),
    ).select(
        "*",
        *[
            F.when(F.col("valid"), F.xxhash64(F.lit(seed), "space", "embedding")).alias(f"k{seed}")
            for seed in (1, 2)
        ],
    )
    classes = (
        rows.filter("valid")
        .groupBy("k1", "k2")
        .agg(
            F.min("vec_id").alias("node"),
            F.count(F.lit(1)).alias("weight"),
            F.any_value("space").alias("space"),
            F.any_value("embedding").alias("embedding"),
        )
    )
    classes = written(classes, "classes")
    if bits is None:
        largest = classes.groupBy("space").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        bits = bit_count(largest or 1)
    tables = table_count(threshold, bits)
    hashed = written(
        classes.select("node", "weight", "space", "embedding").mapInArrow(
            _hash(tables, bits),
            "node bigint, weight bigint, space string, vector binary, codes array<bigint>",
        ),
        "hashed",
    )
    entries = hashed.select("node", "space", F.posexplode("codes").alias("t", "code"))
    sizes = (
        entries.groupBy("space", "t", "code")
        .agg(F.count(F.lit(1)).alias("m"))
        .filter("m > 1")
        .withColumn("parts", F.ceil(F.col("m") / part))
    )
    groups = (
        entries.join(sizes, ["space", "t", "code"])
        .withColumn("part", F.pmod(F.xxhash64("node"), "parts"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
        .select(
            "node", "space", "t", "code", "part",
            F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
        )
    )
    counted = written(
        groups.join(hashed.select("node", "weight", "vector"), "node")
        .repartition(*PLACE)
        .sortWithinPartitions(*PLACE)
        .mapInArrow(_compare(threshold, tables, bits), "node bigint, links bigint, root bigint"),
        "links",
    )
    links = counted.groupBy("node").agg(F.sum("links").alias("links"))
    reached = components(counted.select(F.col("node").alias("a"), F.col("root").alias("b")))
    found = (
        classes.select("k1", "k2", "node", "weight")
        .join(links, "node", "left")
        .join(reached, "node", "left")
        .select(
            "k1",
            "k2",
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("component", "node").alias("component_id"),
        )
    )
    return (
        rows.join(found, ["k1", "k2"], "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
t(node, reached) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT t.node, p.b FROM t JOIN p ON t.reached = p.a),
k AS (SELECT node, min(reached) AS component_id FROM t GROUP BY node),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT node AS vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id,
  node = component_id AS kept
FROM k LEFT JOIN n ON n.a = k.node
"""


@query("op8_embedding_near_dedup", SQL)
def op8(spark, sf_dir):
    return vector_links(table(spark, sf_dir, "embeddings"))

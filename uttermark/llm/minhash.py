"""Near-duplicate documents by min-max hashing of word shingles.

Every permutation keeps its minimum and its maximum, so a signature of 2h values costs
h hash evaluations. Signatures are banded; documents that meet in a band bucket are
compared on their full shingle sets, first with the bucket's smallest document. Documents
of buckets that this leaves in several components are then compared across components,
where prefixes of their rarest shingles meet. Documents of equal sets are one class from
the start, so copies never meet each other as pairs.

Defined cases: a text that is null or without words has the empty set and links with
nothing; a text of fewer words than a shingle has one shingle, the whole sequence. A row
whose id is null links with nothing and is kept. Repeated rows are members of one class
and all carry its component. Extra columns are ignored by ``near_duplicates``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import components, table, written
from .registry import query

MISS = 1e-5  # chance that a pair exactly at the threshold meets in no band
ROWS = 7  # values in a band
CACHE_WORDS = 1 << 20
CHUNK = 2048
MIX = np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    """Word to 64-bit hash; emptied when full, so its memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: bytes | None, words: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles. ``bytes.lower`` and
    ``bytes.split`` touch exactly A-Z and the six ASCII white-space characters."""
    found = text.lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, found), np.uint64, len(found))
    k = min(words, len(h))
    out = np.full(len(h) - k + 1, np.uint64(k * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    for i in range(k):
        out ^= h[i : len(h) - k + 1 + i]
        out *= MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def band_count(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    bands = math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))
    return bands + bands * rows % 2  # minima and maxima come in pairs


class MinMax:
    """Signatures of min-max hashing, as band hashes and as one byte per value."""

    def __init__(self, bands: int, rows: int = ROWS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        evaluations = bands * rows // 2
        draw = lambda n: rng.integers(0, 2**64, n, dtype=np.uint64)
        self.mul = (draw(evaluations) | np.uint64(1))[:, None]
        self.add = draw(evaluations)[:, None]
        self.weights = draw(rows) | np.uint64(1)
        self.names = draw(bands)

    def __call__(self, shingles: np.ndarray) -> tuple[np.ndarray, bytes]:
        low = high = None
        for i in range(0, len(shingles), CHUNK):
            h = shingles[i : i + CHUNK] * self.mul
            h += self.add
            a, b = h.min(axis=1), h.max(axis=1)
            low = a if low is None else np.minimum(low, a)
            high = b if high is None else np.maximum(high, b)
        values = np.stack([low, high], axis=1).reshape(self.bands, self.rows)
        hashes = (values * self.weights).sum(axis=1, dtype=np.uint64) ^ self.names
        hashes *= MIX
        hashes ^= hashes >> np.uint64(31)
        middle = (values * MIX >> np.uint64(56)).astype(np.uint8)
        return hashes.view(np.int64), middle.tobytes()


SIGNED = (
    "doc_id bigint, text_hash bigint, n_shingles bigint, k1 bigint, k2 bigint, "
    "bands array<bigint>, sketch binary"
)


def _arrow(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _sign(words: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, sign = WordHashes(), MinMax(bands)
        empty = np.empty(0, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sizes, one, two, rows, sketches = [], [], [], [], []
                for text in _arrow(batch, "text"):
                    shingles = shingle_set(text.as_py(), words, cache)
                    sizes.append(len(shingles))
                    if len(shingles):
                        digest = xxhash.xxh3_128_intdigest(shingles.tobytes())
                        one.append((digest >> 64) - 2**63)
                        two.append((digest & (2**64 - 1)) - 2**63)
                        row, sketch = sign(shingles)
                    else:
                        one.append(None)
                        two.append(None)
                        row, sketch = empty, b""
                    rows.append(row)
                    sketches.append(sketch)
                offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        _arrow(batch, "doc_id"),
                        _arrow(batch, "text_hash"),
                        pa.array(sizes, pa.int64()),
                        pa.array(one, pa.int64()),
                        pa.array(two, pa.int64()),
                        pa.ListArray.from_arrays(offsets, np.concatenate(rows)),
                        pa.array(sketches, pa.binary()),
                    ],
                    names=["doc_id", "text_hash", "n_shingles", "k1", "k2", "bands", "sketch"],
                )

    return run


def _sets(words: int):
    """The shingle set of each text, as bytes, beside the hash that names the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                names, sets = [], []
                for text in _arrow(batch, "text"):
                    data = shingle_set(text.as_py(), words, cache).tobytes()
                    names.append((xxhash.xxh3_128_intdigest(data) >> 64) - 2**63 if data else None)
                    sets.append(data)
                yield pa.RecordBatch.from_arrays(
                    [
                        _arrow(batch, "doc_id"),
                        pa.array(names, pa.int64()),
                        pa.array(sets, pa.binary()),
                    ],
                    names=["node", "k1", "shingles"],
                )

    return run


def _confirm(num: int, den: int):
    """Keep the pairs with den * |A & B| >= num * |A | B|, counted on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(_arrow(batch, "sa"), _arrow(batch, "sb")):
                a = np.frombuffer(x.as_buffer(), np.uint64)
                b = np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(den * both >= num * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays(
                [_arrow(batch, "a"), _arrow(batch, "b")], names=["a", "b"]
            ).filter(pa.array(keep, pa.bool_()))

    return run


def _plausible(num: int, den: int):
    """Drop pairs whose signatures agree in far fewer values than linked pairs can: by
    seven standard deviations, so that about one linked pair in 10^12 is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = num / den
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([np.frombuffer(v.as_buffer(), np.uint8) for v in _arrow(batch, "sa")])
            y = np.stack([np.frombuffer(v.as_buffer(), np.uint8) for v in _arrow(batch, "sb")])
            agree = (x == y).mean(axis=1)
            keep = agree >= t - 7 * math.sqrt(t * (1 - t) / x.shape[1])
            yield pa.RecordBatch.from_arrays(
                [_arrow(batch, "a"), _arrow(batch, "b")], names=["a", "b"]
            ).filter(pa.array(keep))

    return run


def _with_both(pairs: DataFrame, values: DataFrame, name: str) -> DataFrame:
    left = values.select(F.col("node").alias("a"), F.col(name).alias("sa"))
    right = values.select(F.col("node").alias("b"), F.col(name).alias("sb"))
    return pairs.join(left, "a").join(right, "b")


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(v.as_buffer(), np.int64) for v in _arrow(batch, "shingles")]
        if sets:
            offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(offsets, np.concatenate(sets))
            yield pa.RecordBatch.from_arrays(
                [_arrow(batch, c) for c in ("node", "component", "n")] + [lists],
                names=["node", "component", "n", "shingles"],
            )


def prefix_pairs(
    entries: DataFrame, num: int, den: int, sketches: DataFrame | None = None, alike=True
) -> DataFrame:
    """Candidate pairs (a, b) from different components among sets, given as rows (node,
    component, n, shingle), by prefixes in the order of rising frequency: two sets of
    similarity t share one of the n - ceil(t n) + 1 rarest shingles of the larger and one
    of the n - ceil(2 t n / (1 + t)) + 1 rarest of the smaller. Texts that share a passage
    but not their rare shingles never meet, however many they are, and no link is lost.
    With ``sketches`` (node, sketch, size), pairs are made only where ``alike`` holds, which
    sees these columns of the larger set and ``sa`` and ``la`` of the smaller."""
    often = entries.groupBy("shingle").agg(
        F.count(F.lit(1)).alias("df"),
        F.min("component").alias("c1"),
        F.max("component").alias("c2"),
    )
    order = Window.partitionBy("node").orderBy("df", "shingle")
    wide = F.expr(f"n - ({num} * n + {den} - 1) div {den} + 1")
    narrow = F.expr(f"n - ({2 * num} * n + {num + den} - 1) div {num + den} + 1")
    prefix = written(
        entries.join(often, "shingle")
        .withColumn("rank", F.row_number().over(order))
        .filter((F.col("rank") <= wide) & (F.col("c1") < F.col("c2")))
        .select(
            "shingle", "node", "component", "n", "rank", (F.col("rank") <= narrow).alias("narrow")
        ),
        "prefix",
    )
    seen = []
    if sketches is not None:
        prefix = prefix.join(sketches, "node")
        seen = [F.col("sketch").alias("sa"), F.col("size").alias("la")]
    small = prefix.filter("narrow").select(
        "shingle",
        F.col("node").alias("a"),
        F.col("component").alias("ca"),
        F.col("n").alias("na"),
        F.col("rank").alias("ra"),
        *seen,
    )
    # The first shingle that a linked pair shares leaves enough others behind it.
    behind = 1 + F.least(F.col("n") - F.col("rank"), F.col("na") - F.col("ra"))
    return (
        prefix.join(small, "shingle")
        .filter(
            (F.col("component") != F.col("ca"))
            & ((F.col("n") > F.col("na")) | ((F.col("n") == F.col("na")) & (F.col("node") > F.col("a"))))
            & (den * F.col("na") >= num * F.col("n"))
            & ((num + den) * behind >= num * (F.col("n") + F.col("na")))
            & alike
        )
        .select("a", F.col("node").alias("b"))
        .distinct()
    )


def near_duplicates(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Components of documents linked by a Jaccard similarity of at least num / den on
    sets of ``words``-word shingles.

    Returns one row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id,
    kept. ``kept`` marks the smallest id of each component.
    """
    return _judged(docs, words, num, den).drop("text_hash")


def _judged(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    bands = band_count(num / den)
    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.xxhash64("text").alias("text_hash"),
        F.col("text").cast("binary").alias("text"),
    )
    signed = written(texts.mapInArrow(_sign(words, bands), SIGNED), "signed")
    filled = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = written(
        filled.groupBy("k1", "k2").agg(
            F.min("doc_id").alias("node"),
            F.any_value("n_shingles").alias("n"),
            F.any_value("bands").alias("bands"),
            F.any_value("sketch").alias("sketch"),
        ),
        "classes",
    )

    entries = classes.select(F.explode("bands").alias("bucket"), "node", "n")
    buckets = written(
        entries.groupBy("bucket")
        .agg(F.min(F.struct("node", "n")).alias("first"), F.count(F.lit(1)).alias("m"))
        .filter("m > 1")
        .select("bucket", F.col("first.node").alias("pivot"), F.col("first.n").alias("pivot_n")),
        "buckets",
    )
    members = written(entries.join(buckets, "bucket").filter("node <> pivot"), "members")

    def sized(x: str, y: str):
        """No two sets of these sizes can be linked otherwise."""
        return den * F.least(x, y) >= num * F.greatest(x, y)

    def sets_of(nodes: DataFrame) -> DataFrame:
        """``nodes`` with the shingle set of each node."""
        named = classes.select("node", "k1", "n").join(nodes, "node")
        sets = texts.join(named.select(F.col("node").alias("doc_id")), "doc_id").mapInArrow(
            _sets(words), "node bigint, k1 bigint, shingles binary"
        )
        # A repeated id may stand for several texts; the name of the set picks the right one.
        return sets.join(named, ["node", "k1"]).dropDuplicates(["node", "k1"])

    def confirmed(pairs: DataFrame) -> DataFrame:
        likely = written(
            _with_both(pairs, classes, "sketch").mapInArrow(
                _plausible(num, den), "a bigint, b bigint"
            ),
            "likely",
        )
        needed = likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct()
        sets = written(sets_of(needed), "sets")
        return written(
            _with_both(likely, sets, "shingles").mapInArrow(
                _confirm(num, den), "a bigint, b bigint"
            ),
            "links",
        )

    near_first = confirmed(
        members.filter(sized("n", "pivot_n"))
        .select(F.col("pivot").alias("a"), F.col("node").alias("b"))
        .distinct()
    )
    known = components(near_first)

    # All members have met the first document of their bucket. Where the members lie in
    # one component, the bucket is settled; elsewhere pairs across components are left.
    placed = written(
        members.select("bucket", "node").join(known, "node", "left").select(
            "bucket", "node", F.coalesce("component", "node").alias("component")
        ),
        "placed",
    )
    open_buckets = (
        placed.groupBy("bucket")
        .agg(F.min("component").alias("c1"), F.max("component").alias("c2"))
        .filter("c1 < c2")
        .select("bucket")
    )
    rest = placed.join(open_buckets, "bucket").select("node", "component").distinct()
    listed = written(sets_of(rest), "open").mapInArrow(
        _listed, "node bigint, component bigint, n bigint, shingles array<bigint>"
    )
    entries = listed.select("node", "component", "n", F.explode("shingles").alias("shingle"))
    across = prefix_pairs(written(entries, "entries"), num, den)
    links = near_first.unionByName(confirmed(across))
    reached = components(links)

    found = classes.join(reached, "node", "left").select(
        "k1", "k2", F.coalesce("component", "node").alias("component")
    )
    return (
        signed.select("doc_id", "text_hash", "n_shingles", "k1", "k2")
        .join(found, ["k1", "k2"], "left")
        .select(
            "doc_id",
            "text_hash",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias(
                "component_id"
            ),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def without_near_duplicates(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns. Of rows that repeat both
    id and text, one stays."""
    judged = written(_judged(docs.select("doc_id", "text"), words, num, den), "judged")
    keyed = docs.withColumn("_hash", F.xxhash64("text"))
    same = ["doc_id", "_hash"]

    def named(rows: DataFrame) -> DataFrame:
        return rows.select("doc_id", F.col("text_hash").alias("_hash"))

    left = keyed.join(named(judged.filter("NOT kept")).distinct(), same, "left_anti")
    repeated = written(
        named(judged.filter("kept AND doc_id IS NOT NULL")).groupBy(*same).count().filter("count > 1"),
        "repeated",
    ).drop("count")
    if not repeated.isEmpty():
        once = left.join(repeated, same, "left_semi").dropDuplicates(same)
        left = left.join(repeated, same, "left_anti").unionByName(once)
    return left.select(*docs.columns)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE
    WHEN w IS NULL OR len(w) = 0 THEN []
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s
  FROM w),
c AS (SELECT s, min(doc_id) AS node, len(any_value(s)) AS n FROM
  (SELECT doc_id, list_sort(s) AS s FROM s WHERE len(s) > 0) GROUP BY s),
x AS (SELECT node, n, unnest(s) AS g FROM c),
r AS (SELECT g FROM x GROUP BY g HAVING count(*) > 1),
y AS (SELECT node, n, g FROM x SEMI JOIN r USING (g)),
p AS (SELECT a.node AS a, b.node AS b FROM y a JOIN y b ON a.g = b.g AND a.node < b.node
  AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
t(node, reached) AS (
  SELECT node, node FROM c UNION SELECT t.node, e.b FROM t JOIN e ON t.reached = e.a),
k AS (SELECT node, min(reached) AS component FROM t GROUP BY node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(k.component, s.doc_id) AS component_id,
  s.doc_id = coalesce(k.component, s.doc_id) AS kept
FROM s LEFT JOIN c ON list_sort(s.s) = c.s LEFT JOIN k ON k.node = c.node
"""


@query("op3_minhash_near_dedup", SQL)
def op3(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, num=85, den=100)

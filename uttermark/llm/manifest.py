"""Merkle manifest of a dataset: a tree of SHA-256 digests that proves every row's place.

Every document is a leaf, leaves of a source form a tree, and the trees' roots form the
tree of the dataset. A run of at most three neighbours has one parent, the digest of their
hexadecimal texts. While a parent is made it keeps a copy of its hash state before each
child; to fold a changed child upward, the state before its slot is resumed with the new
digest and the siblings to the right alone, so the left ones are never hashed again.

Trees are cut into subtrees of 3^7 nodes, each the work of one task, level above level, so
a source of any size is spread out. What lies above a subtree reaches its task as one
path: the states to resume there are made once and copied for each of its documents. A
document's siblings never leave the task that folds it.

Defined cases: a null is written ``-``, in the id as well, and an empty text ``0:``. A null
source is a source of its own and comes first; null ids come first in their source, and are
not tampered with. Rows of one id follow each other by leaf; rows equal in all five columns
are leaves of their own, and it is open which of their equal leaves has which place. A
source of one document has the leaf as its root. Empty tables give no rows. Texts of any length
are hashed whole, by Spark. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import broadcast_if_small, table, written
from .registry import query

RUN = 3
LEVELS = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_of(values: Sequence[Column]) -> Column:
    """Digest of the values, each with its length in bytes before it."""
    texts = [v.cast("string") for v in values]
    parts = [
        F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
        for t in texts
    ]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def grow(digests: list[bytes], levels: int | None):
    """Rows of digests from the leaves up, and for each parent the states before its
    children. Without ``levels`` the last row has one digest."""
    rows, states = [digests], []
    while len(states) < levels if levels is not None else len(rows[-1]) > 1:
        below, up, kept = rows[-1], [], []
        for at in range(0, len(below), RUN):
            state, before = sha256(), []
            for child in below[at : at + RUN]:
                before.append(state.copy())
                state.update(child)
            kept.append(before)
            up.append(state.hexdigest().encode())
        rows.append(up)
        states.append(kept)
    return rows, states


def siblings(rows: list[list[bytes]], place: int) -> list[tuple[bytes, bytes]]:
    """For each level, what stands left and right of the node in its run."""
    found = []
    for below in rows[:-1]:
        start = place - place % RUN
        found.append((b"".join(below[start:place]), b"".join(below[place + 1 : start + RUN])))
        place //= RUN
    return found


def fold(digest: bytes, place: int, states: list, sides: list[tuple[bytes, bytes]]) -> bytes:
    """Root of the subtree once its leaf at ``place`` is ``digest``."""
    for kept, (_, right) in zip(states, sides):
        place, slot = divmod(place, RUN)
        state = kept[place][slot].copy()
        state.update(digest)
        state.update(right)
        digest = state.hexdigest().encode()
    return digest


def _subtree(group: pa.Table, levels: int):
    """The group's rows in their order, rows of digests and states. A subtree that is not
    its whole tree has all levels, however few leaves the last one has."""
    group = group.sort_by("pos")
    digests = [d.hex().encode() for d in group.column("digest").to_pylist()]
    part = group.column("total")[0].as_py() > RUN**levels
    return group, *grow(digests, levels if part else None)


def _root(levels: int):
    def run(group: pa.Table) -> pa.Table:
        group, rows, _ = _subtree(group, levels)
        size, total = RUN**levels, group.column("total")[0].as_py()
        return pa.table(
            {
                "key": [group.column("key")[0].as_py()],
                "pos": pa.array([group.column("pos")[0].as_py() // size], pa.int64()),
                "total": pa.array([-(-total // size)], pa.int64()),
                "digest": pa.array([bytes.fromhex(rows[-1][0].decode())], pa.binary()),
            }
        )

    return run


PATH = "array<struct<left:string,right:string>>"
NODE = "key string, pos bigint, total bigint, digest binary"


def _paths(levels: int):
    """The path of each node: what its subtree adds, then the path of the subtree."""

    def run(group: pa.Table, above: pa.Table) -> pa.Table:
        group, rows, _ = _subtree(group, levels)
        upper = above.column("path")[0].as_py()
        own = [
            [{"left": a.decode(), "right": b.decode()} for a, b in siblings(rows, i)] + upper
            for i in range(group.num_rows)
        ]
        kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        n = group.num_rows
        return pa.table(
            {
                "key": group.column("key"),
                "pos": group.column("pos"),
                "path": pa.array(own, kind),
                "subroot": pa.array(above.column("subroot").to_pylist() * n, pa.string()),
                "root": pa.array(above.column("root").to_pylist() * n, pa.string()),
            }
        )

    return run


def _proofs(levels: int):
    """The result rows of one subtree of documents."""

    def run(group: pa.Table, above: pa.Table) -> pa.Table:
        group, rows, states = _subtree(group, levels)
        upper = [
            (x["left"].encode(), x["right"].encode()) for x in above.column("path")[0].as_py()
        ]
        resumed = [[[sha256(left)]] for left, _ in upper]  # made once, copied for each document
        outer = b"".join(left + right for left, right in upper)
        root, proofs, folded = above.column("root")[0].as_py(), [], []
        for i, changed in enumerate(group.column("changed").to_pylist()):
            sides = siblings(rows, i)
            proof = sha256(b"".join(left + right for left, right in sides))
            proof.update(outer)
            proofs.append(proof.hexdigest())
            leaf = rows[0][i] if changed is None else changed.hex().encode()
            digest = fold(leaf, i, states, sides)
            folded.append(fold(digest, 0, resumed, upper).decode())
        n = group.num_rows
        return pa.table(
            {
                "doc_id": group.column("doc_id"),
                "leaf": pa.array([d.decode() for d in rows[0]]),
                "subroot": pa.array(above.column("subroot").to_pylist() * n, pa.string()),
                "root": pa.array([root] * n, pa.string()),
                "proof_sha256": pa.array(proofs, pa.string()),
                "folded_root": pa.array(folded, pa.string()),
                "verified": pa.array([f == root for f in folded], pa.bool_()),
            }
        )

    return run


def placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``pos``, the place of a row within its ``key`` by the columns of
    ``order`` from 0 on, and ``total``, the rows of the key. Rows are dealt out by ranges
    and numbered inside, so no key is sorted in one task."""
    ranges = written(
        rows.repartitionByRange("key", *order)
        .sortWithinPartitions("key", *order)
        .select(
            "*",
            F.spark_partition_id().alias("_range"),
            F.monotonically_increasing_id().alias("_at"),
        ),
        "ordered",
    )
    before = Window.partitionBy("key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = written(
        ranges.groupBy("key", "_range")
        .agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
        .select(
            "key", "_range",
            (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
            F.sum("_rows").over(Window.partitionBy("key")).alias("total"),
        ),
        "ranges",
    )
    small = broadcast_if_small(sizes, size=F.octet_length("key") + 40)
    return ranges.join(small, ["key", "_range"]).select(
        *rows.columns, (F.col("_at") + F.col("_shift")).alias("pos"), "total"
    )


def climb(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """``nodes`` (key, pos, total, digest), then the roots of their subtrees, and so on up to
    one node for each key. The number of rounds is the logarithm of the largest key."""
    found = [nodes]
    while (found[-1].agg(F.max("total")).first()[0] or 0) > 1:
        cut = found[-1].select("key", "pos", "total", "digest").withColumn(
            "chunk", F.floor(F.col("pos") / RUN**levels)
        )
        found.append(written(cut.groupBy("key", "chunk").applyInArrow(_root(levels), NODE), "roots"))
    return found


def _down(nodes: DataFrame, paths: DataFrame, levels: int, fn, schema: str) -> DataFrame:
    chunked = nodes.withColumn("chunk", F.floor(F.col("pos") / RUN**levels))
    return (
        chunked.groupBy("key", "chunk")
        .cogroup(paths.withColumnRenamed("pos", "chunk").groupBy("key", "chunk"))
        .applyInArrow(fn(levels), schema)
    )


def manifest(
    docs: DataFrame, tampered: Column, tamper: Column, levels: int = LEVELS
) -> DataFrame:
    """Digests and proofs of ``docs`` (the columns of ``FIELDS``).

    Where ``tampered``, the text is taken to have become ``tamper``. Returns one row per
    document: doc_id, leaf, subroot (of its source), root, proof_sha256 (digest of all its
    siblings up to the root), folded_root (the root that its own leaf, tampered with or
    not, and the siblings give), verified (it is the root). One task holds a subtree of
    3^``levels`` nodes.
    """
    values = [F.col(c) for c in FIELDS]
    changed = leaf_of([*values[:-1], tamper])
    leaves = written(
        docs.select(
            # Prefixed, sources sort as they did, and a null one comes first.
            F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("key"),
            "doc_id",
            leaf_of(values).alias("digest"),
            F.when(tampered & ~tamper.eqNullSafe(F.col("text")), changed).alias("changed"),
        ),
        "leaves",
    )
    documents = written(placed(leaves, ["doc_id", "digest"]), "documents")
    by_source = climb(documents, levels)
    top = by_source[-1].select("key", "digest")
    sources = written(
        placed(top.select(F.lit("").alias("key"), F.col("key").alias("name"), "digest"), ["name"]),
        "sources",
    )
    dataset = climb(sources, levels)
    nothing = F.array().cast(PATH)
    whole = dataset[-1].select("key", "pos", nothing.alias("path"), F.hex("digest").alias("root"))
    paths = whole.select(
        "key", "pos", "path", F.lit(None).cast("string").alias("subroot"), F.lower("root").alias("root")
    )
    columns = f"key string, pos bigint, path {PATH}, subroot string, root string"
    for nodes in reversed(dataset[:-1]):
        plain = nodes.select("key", "pos", "total", "digest")
        paths = written(_down(plain, paths, levels, _paths, columns), "paths")
    paths = paths.drop("key", "subroot").join(
        sources.select("pos", F.col("name").alias("key"), F.lower(F.hex("digest")).alias("subroot")),
        "pos",
    ).withColumn("pos", F.lit(0).cast("bigint"))
    for nodes in reversed(by_source[1:-1]):
        paths = written(_down(nodes, paths, levels, _paths, columns), "paths")
    kind = docs.schema["doc_id"].dataType.simpleString()
    result = (
        f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, "
        "folded_root string, verified boolean"
    )
    paths = paths.select("key", "pos", "path", "subroot", "root")
    return _down(documents, paths, levels, _proofs, result)


SQL = r"""
WITH RECURSIVE a AS (
  SELECT doc_id, coalesce('=' || source, '') AS s, concat(
      CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END,
      CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
      CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END,
      CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END) AS head,
    text, CASE WHEN list_reduce([ascii(c) for c in string_split(doc_id::VARCHAR, '')],
        lambda c, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7],
          lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END,
          xor(c, b::BIGINT)), 4294967295::BIGINT) % 2 = 1
      THEN replace(text, chr(10), '') ELSE text END AS after FROM documents),
b AS (SELECT doc_id, s, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
    sha256(head || CASE WHEN after IS NULL THEN '-' ELSE strlen(after) || ':' || after END) AS changed FROM a),
d AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    row_number() OVER () AS r FROM b),
n(lvl, s, pos, h) AS (SELECT 0, s, pos, leaf FROM d UNION ALL
  SELECT lvl + 1, s, pos // 3, sha256(string_agg(h, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY s) AS m FROM n) WHERE m > 1 GROUP BY lvl, s, pos // 3),
t AS (SELECT s, max(lvl) AS depth, max_by(h, lvl) AS subroot FROM n GROUP BY s),
u AS (SELECT *, row_number() OVER (ORDER BY s) - 1 AS pos FROM t),
m(lvl, pos, h) AS (SELECT 0, pos, subroot FROM u UNION ALL
  SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER () AS m FROM m) WHERE m > 1 GROUP BY lvl, pos // 3),
w AS (SELECT max(lvl) AS depth, max_by(h, lvl) AS root FROM m),
q AS (SELECT d.r, d.s, d.pos, d.changed, u.depth, u.pos AS top, u.depth + w.depth AS height
  FROM d JOIN u USING (s), w),
-- For each step of a document's way up: the tree, the level and the place there.
v AS (SELECT r, k, k >= depth AS outer_tree, CASE WHEN k < depth THEN s ELSE '' END AS s,
    CASE WHEN k < depth THEN k ELSE k - depth END AS lvl,
    CASE WHEN k < depth THEN pos ELSE top END // (3 ** CASE WHEN k < depth THEN k ELSE k - depth END)::BIGINT AS place
  FROM (SELECT *, unnest(range(height)) AS k FROM q)),
x AS (SELECT FALSE AS outer_tree, lvl, s, pos, h FROM n UNION ALL SELECT TRUE, lvl, '', pos, h FROM m),
e AS (SELECT v.r, v.k, x.pos, x.h, x.pos = v.place AS own FROM v JOIN x ON x.outer_tree = v.outer_tree
  AND x.s = v.s AND x.lvl = v.lvl AND x.pos // 3 = v.place // 3),
f(r, k, cur, proof) AS (SELECT r, 0, changed, '' FROM q UNION ALL
  SELECT f.r, f.k + 1, sha256(string_agg(CASE WHEN own THEN cur ELSE h END, '' ORDER BY pos)),
    any_value(proof) || coalesce(string_agg(h, '' ORDER BY pos) FILTER (NOT own), '')
  FROM f JOIN e ON e.r = f.r AND e.k = f.k GROUP BY f.r, f.k)
SELECT d.doc_id, d.leaf, u.subroot, w.root, sha256(f.proof) AS proof_sha256, f.cur AS folded_root,
  f.cur = w.root AS verified
FROM f JOIN q ON f.r = q.r AND f.k = q.height JOIN d ON d.r = f.r JOIN u ON u.s = d.s, w
"""


@query("op11_merkle_manifest", SQL)
def op11(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    return manifest(docs, even, F.translate("text", "\n", ""))

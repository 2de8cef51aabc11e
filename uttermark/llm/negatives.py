"""Hard negatives by slot-decomposed selection.

Each positive of an anchor has a window of scores for its negatives, and the windows of one
anchor overlap. Their upper limits cut the scores into disjoint slots, the highest first.
The rows of other labels are scored against the anchor once, whatever the number of its
positives: a block keeps the best ``k`` of each slot, and so does the merge of blocks. The
best of a window are then those of its own slot and all lower ones, which one pass from the
lowest slot upward gives for every window, as each merges its slot into what lies below;
the lower limit only ends a list that is sorted by score.

Anchors meet rows in blocks of bounded size, of their own label for positives, of all labels
for negatives, so neither a hot label nor many anchors come together in one task.

Defined cases: rows whose id, label or vector is null, or whose vector has a null or
non-finite component, take no part; nor do vectors whose scaled norm is 2^28 or more, whose
scores could leave 64 bits. Vectors of different lengths are never compared. Repeated
rows are rows of their own: one may be the positive of the other, and each anchor among
them gives its own rows. A window of a negative positive score is empty. Extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import table, written
from .registry import query
from .whole import best, in_blocks, lowest, matrix, products, whole_vectors

PART, CHUNK, STEP = 2048, 1024, 256
HIT = "uid bigint, slot int, neg bigint, vec_id bigint"


def _hits(uids: list, slots: list, scores: list, ids: list) -> pa.Table:
    join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts]).astype(kind)
    return pa.table(
        {
            "uid": join(uids, np.int64), "slot": join(slots, np.int32),
            "neg": -join(scores, np.int64), "vec_id": join(ids, np.int64),
        }
    )


def _each(anchors: pa.Table, rows: pa.Table):
    """Anchors in steps, with their exact scores against all rows in the order of ids."""
    rows = rows.sort_by("vec_id")
    right = matrix(rows)
    for at in range(0, anchors.num_rows, STEP):
        step = anchors.slice(at, STEP)
        yield step, rows, products(matrix(step), right)


def _positives(k: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found = [[], [], [], []]
        if anchors.num_rows and rows.num_rows:
            for step, rows, scores in _each(anchors, rows):
                uid = step.column("uid").to_numpy()
                scores[uid[:, None] == rows.column("uid").to_numpy()] = lowest(scores)
                r, c, s = best(scores, k)
                ids = rows.column("vec_id").to_numpy()[c]
                for part, more in zip(found, (uid[r], np.zeros(len(r)), s, ids)):
                    part.append(more)
        return _hits(*found)

    return run


def _negatives(k: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found = [[], [], [], []]
        if anchors.num_rows and rows.num_rows:
            for step, rows, scores in _each(anchors, rows):
                none, uid = lowest(scores), step.column("uid").to_numpy()
                same = step.column("label").to_numpy()[:, None] == rows.column("label").to_numpy()
                scores[same] = none
                limits = step.column("limits").to_pylist()
                bottom = np.array(step.column("bottom").to_pylist(), scores.dtype)
                scores[scores < bottom[:, None]] = none
                for slot in range(max(map(len, limits))):
                    # A slot reaches from its own limit down to the next one.
                    top = np.array([x[slot] if slot < len(x) else none for x in limits], scores.dtype)
                    low = np.array(
                        [x[slot + 1] if slot + 1 < len(x) else none for x in limits], scores.dtype
                    )
                    inside = (scores <= top[:, None]) & (scores > low[:, None])
                    r, c, s = best(np.where(inside, scores, none), k)
                    ids = rows.column("vec_id").to_numpy()[c]
                    for part, more in zip(found, (uid[r], np.full(len(r), slot), s, ids)):
                        part.append(more)
        return _hits(*found)

    return run


def _top(hits: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each (uid, slot); Spark cuts before the shuffle as well."""
    order = Window.partitionBy("uid", "slot").orderBy("neg", "vec_id")
    return hits.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).drop("_n")


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, scale: int = 256, positives: int = 5, k: int = 3,
    low: int = 50, high: int = 95, base: int = 100,
) -> DataFrame:
    """Negatives of ``vectors`` (vec_id, embedding, label), scored in whole numbers.

    For each anchor and each of its first ``positives`` rows of the same label, the first
    ``k`` rows of other labels with low * positive <= base * score <= high * positive.
    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    if not (0 <= low and 0 <= high and 0 < base and max(low, high, base) <= 128):
        raise ValueError("limits are fractions of whole numbers up to 128")
    slim = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"), "embedding",
    ).filter("vec_id IS NOT NULL AND label IS NOT NULL")
    rows = written(
        whole_vectors(slim, scale).withColumn("uid", F.monotonically_increasing_id()), "vectors"
    )
    anchors = rows.filter("anchor").drop("anchor")
    near = in_blocks(
        anchors, rows.drop("anchor"), ["label", "length"], _positives(positives), HIT, PART, CHUNK
    )
    chosen = written(
        _top(near, positives)
        .groupBy("uid")
        .agg(F.array_sort(F.collect_list(F.struct("neg", "vec_id"))).alias("positives")),
        "positives",
    )
    # Windows of negative scores are empty: half of one lies above all of it.
    scored = F.filter(F.transform("positives", lambda p: -p["neg"]), lambda s: s >= 0)
    asked = written(
        anchors.join(chosen, "uid")
        .withColumn("_s", scored)
        .filter(F.size("_s") > 0)
        .select(
            "uid", "vec_id", "label", "length", "vector", "positives",
            F.expr(
                f"reverse(array_sort(array_distinct(transform(_s, s -> ({high} * s) div {base}))))"
            ).alias("limits"),
            F.expr(f"({low} * array_min(_s)) div {base}").alias("bottom"),
        ),
        "asked",
    )
    slots = _top(
        in_blocks(
            asked.select("uid", "label", "length", "vector", "limits", "bottom"),
            rows.drop("anchor"), ["length"], _negatives(k), HIT, PART, CHUNK,
        ),
        k,
    )
    lists = slots.groupBy("uid").agg(F.collect_list(F.struct("slot", "neg", "vec_id")).alias("hits"))

    def merged(above: Column, slot: Column) -> Column:
        """The list of this slot and all lower ones, in front of the lists of those."""
        own = F.transform(
            F.filter("hits", lambda h: h["slot"] == slot),
            lambda h: F.struct(h["neg"].alias("neg"), h["vec_id"].alias("vec_id")),
        )
        below = F.coalesce(F.try_element_at(above, F.lit(1)), F.array().cast(LIST))
        return F.concat(F.array(F.slice(F.array_sort(F.concat(own, below)), 1, k)), above)

    upward = F.sequence(F.size("limits") - 1, F.lit(0), F.lit(-1))
    windows = F.aggregate(upward, F.array().cast(f"array<{LIST}>"), merged)
    each = (
        asked.drop("vector", "label", "length", "bottom")
        .join(lists, "uid")
        .select(
            F.col("vec_id").alias("anchor_id"), "limits", windows.alias("windows"),
            F.explode("positives").alias("p"),
        )
        .select(
            "anchor_id", F.col("p.vec_id").alias("positive_id"), (-F.col("p.neg")).alias("positive_score"),
            "limits", "windows",
        )
        .filter("positive_score >= 0")
    )
    slot = F.expr(f"array_position(limits, ({high} * positive_score) div {base})").cast("int")
    window = F.filter(
        F.element_at("windows", slot), lambda h: -h["neg"] * base >= low * F.col("positive_score")
    )
    return each.select("anchor_id", "positive_id", "positive_score", F.posexplode(window)).select(
        "anchor_id", "positive_id", (F.col("pos") + 1).cast("int").alias("rank"),
        F.col("col.vec_id").alias("negative_id"), "positive_score",
        (-F.col("col.neg")).alias("negative_score"),
    )


LIST = "array<struct<neg:bigint,vec_id:bigint>>"

SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id,
    CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS anchor, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.r <> b.r AND a.vec_id % 50 = 0 AND len(a.e) = len(b.e)),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS n FROM s
  WHERE same QUALIFY n <= 5),
c AS (SELECT p.anchor, p.n, p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id,
    p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.n ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same
    AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score
FROM c WHERE rank <= 3
"""


@query("op12_hard_negatives", SQL)
def op12(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("bigint")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 50 == 0)

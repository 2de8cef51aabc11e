"""Exact top-k by inner product: dual-tree search over cover trees.

Queries and data share one index. Its upper part is a net of centers, by farthest-first
choice from a bounded sample; every row is put to its nearest center, and each node has two
covering radii, that of its data and that of its queries. Nodes of many rows are cut into
parts of bounded size, over which a task grows the lower part, again by farthest-first
choice: the children of a node are a net of its points as fine as the last of them was far.

No product between two nodes exceeds that of their centers by more than the radii allow. A
group of queries first meets a part of its own node, which gives each query a kth score.
Only parts that may beat the worst of these, or tie with it, are visited then, and inside
the task the same bound prunes pairs of tree nodes, with kth scores that rise on the way.
Scores are exact whole numbers. Where vectors spread in all directions, as random ones do, no
bound prunes and the search is one of bounded blocks; nothing is left out in either case.

Defined cases: rows whose id or vector is null, or whose vector has a null or non-finite
component, take no part; nor do vectors whose scaled norm is 2^28 or more, whose scores
could leave 64 bits. Vectors of different lengths are never compared; a length that the
sample does not hold is a node around the origin. Repeated rows are rows of their own, and
each query among them gives its own rows. Extra columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import broadcast_if_small, table, written
from .registry import query
from .whole import best, fresh, lowest, matrix, products, whole_vectors

#: The upper net: at most so many centers, chosen from so many sampled rows and bytes.
CENTERS = 256
SAMPLE = 8192
SAMPLE_BYTES = 32_000_000
PART, GROUP, CHUNK = 2048, 256, 1024
CHILDREN, LEAF = 8, 64
#: Below all scores, and fit to be negated.
NOTHING = -(1 << 62)
#: Bounds are taken in doubles, this much above what rounding can take away.
SLACK = 1e-9


def farthest_first(points: np.ndarray, first: int, most: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """At most ``most`` rows, each as far as can be from those before it; for each point
    its nearest one (the first of several) and the distance to it."""
    chosen, away = [first], np.sqrt(((points - points[first]) ** 2).sum(axis=1))
    nearest = np.zeros(len(points), np.int64)
    while len(chosen) < most:
        at = int(away.argmax())
        if away[at] == 0:
            break
        found = np.sqrt(((points - points[at]) ** 2).sum(axis=1))
        closer = found < away
        nearest[closer], away[closer] = len(chosen), found[closer]
        chosen.append(at)
    return chosen, nearest, away


class CoverTree:
    """Nodes over ``points``: a center that is one of them, a covering radius, and
    either children or the points of a leaf."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, children: int = CHILDREN) -> None:
        self.points, self.center, self.radius = points, [], []
        self.children: list[list[int]] = []
        self.members: list[np.ndarray] = []
        middle = ((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin()
        todo = [(self._node(int(middle), np.arange(len(points))), int(middle))]
        while todo:
            node, center = todo.pop()
            members = self.members[node]
            if len(members) <= leaf or self.radius[node] == 0:
                continue
            own = int(np.flatnonzero(members == center)[0])
            chosen, nearest, _ = farthest_first(points[members], own, children)
            for i, at in enumerate(chosen):
                child = self._node(int(members[at]), members[nearest == i])
                self.children[node].append(child)
                todo.append((child, int(members[at])))
        self.centers = points[self.center]
        self.norms = np.sqrt((self.centers**2).sum(axis=1))
        self.radii = np.array(self.radius)

    def _node(self, center: int, members: np.ndarray) -> int:
        away = ((self.points[members] - self.points[center]) ** 2).sum(axis=1)
        self.center.append(center)
        self.radius.append(float(np.sqrt(away.max())))
        self.children.append([])
        self.members.append(members)
        return len(self.center) - 1


def bound(dot, left_norm, left_radius, right_norm, right_radius):
    """No product of a point around one center and one around the other is larger. Of
    numbers or of columns."""
    slack = SLACK * (left_norm + left_radius) * (right_norm + right_radius) + 1e-6
    return dot + left_norm * right_radius + right_norm * left_radius + left_radius * right_radius + slack


class Search:
    """The best ``k`` of each query among data seen so far; ``floor`` is what a score
    must reach to matter."""

    def __init__(self, uids: np.ndarray, vectors: np.ndarray, floors: np.ndarray, k: int) -> None:
        self.uids, self.vectors, self.floors, self.k = uids, vectors, floors.copy(), k
        self.scores = np.full((len(uids), k), NOTHING)
        self.ids = np.full((len(uids), k), np.iinfo(np.int64).max)
        self.visited = 0

    def compare(self, q: np.ndarray, uids: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Let the queries ``q`` meet some data, exactly."""
        self.visited += len(q) * len(ids)
        scores = products(self.vectors[q], vectors)
        scores[self.uids[q][:, None] == uids] = lowest(scores)
        hot = scores.max(axis=1) >= self.floors[q]
        if not hot.any():
            return
        q, scores = q[hot], scores[hot]
        order = np.argsort(ids, kind="stable")
        r, c, s = best(scores[:, order], self.k)
        # What was found joins the lists, which are sorted by score and id once more.
        rank = np.zeros(len(r), np.int64)
        turn = np.lexsort((np.arange(len(r)), r))
        starts = np.searchsorted(r[turn], np.arange(len(q)))
        rank[turn] = np.arange(len(r)) - starts[r[turn]]
        new_scores = np.full((len(q), self.k), NOTHING)
        new_ids = np.full((len(q), self.k), np.iinfo(np.int64).max)
        new_scores[r, rank], new_ids[r, rank] = s, ids[order][c]
        scores = np.concatenate([self.scores[q], new_scores], axis=1)
        found = np.concatenate([self.ids[q], new_ids], axis=1)
        first = np.lexsort((found, -scores), axis=1)[:, : self.k]
        self.scores[q] = np.take_along_axis(scores, first, axis=1)
        self.ids[q] = np.take_along_axis(found, first, axis=1)
        kth = self.scores[q][:, -1]
        known = kth > NOTHING
        self.floors[q[known]] = np.maximum(self.floors[q[known]], kth[known])

    def walk(self, left: CoverTree, place: np.ndarray, right: CoverTree, uids, ids) -> None:
        """Visit the pairs of nodes that can matter; ``place`` has the query of each
        point on the left. Of the children of a node, the most promising come first."""
        todo = [(0, 0)]
        while todo:
            a, b = todo.pop()
            queries = place[left.members[a]]
            highest = bound(
                left.centers[a] @ right.centers[b], left.norms[a], left.radii[a], right.norms[b], right.radii[b]
            )
            if highest < self.floors[queries].min():
                continue
            if left.children[a] and (not right.children[b] or left.radii[a] >= right.radii[b]):
                todo += [(child, b) for child in left.children[a]]
            elif right.children[b]:
                below = np.array(right.children[b])
                reach = right.centers[below] @ left.centers[a] + right.radii[below] * left.norms[a]
                todo += [(a, int(child)) for child in below[np.argsort(reach, kind="stable")]]
            else:
                members = right.members[b]
                self.compare(queries, uids[members], ids[members], right.points[members])

    def rows(self) -> pa.Table:
        r, c = np.nonzero(self.scores > NOTHING)
        return pa.table({"uid": self.uids[r], "vec_id": self.ids[r, c], "score": self.scores[r, c]})


FOUND = "uid bigint, vec_id bigint, score bigint"


def _search(k: int):
    """Queries, each with its group and floor, against one part of the data."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        uids = queries.column("uid").to_numpy().astype(np.int64)
        floors = queries.column("floor").to_pylist()
        floors = np.array([NOTHING if f is None else f for f in floors], np.int64)
        state = Search(uids, matrix(queries), floors, k)
        if len(uids) and rows.num_rows:
            right = CoverTree(matrix(rows))
            own, ids = rows.column("uid").to_numpy(), rows.column("vec_id").to_numpy()
            groups = np.array(queries.column("group").to_pylist())
            for group in np.unique(groups):
                place = np.flatnonzero(groups == group)
                state.walk(CoverTree(state.vectors[place]), place, right, own, ids)
        return state.rows()

    return run


def upper_net(rows: DataFrame, part: int) -> dict[int, np.ndarray]:
    """Centers by length of the vectors, from a sample of bounded rows and bytes: those
    of the smallest hashes."""
    n, longest = rows.agg(F.count(F.lit(1)), F.max("length")).first()
    if not n:
        return {}
    size = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * max(longest, 1))))
    drawn = rows.select("length", "vector").orderBy(F.xxhash64("vector", "uid")).limit(size).collect()
    most = max(1, min(CENTERS, n // part))
    net = {}
    for length in sorted({r["length"] for r in drawn}):
        points = np.frombuffer(
            b"".join(bytes(r["vector"]) for r in drawn if r["length"] == length), np.float64
        ).reshape(-1, length) if length else np.zeros((1, 0))
        middle = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
        net[length] = points[farthest_first(points, middle, most)[0]]
    return net


def _assign(net: dict[int, np.ndarray]):
    """Nearest center of each row and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                node = np.full(batch.num_rows, -1, np.int32)
                away = np.zeros(batch.num_rows)
                lengths = batch.column("length").to_numpy()
                for length in np.unique(lengths):
                    there = np.flatnonzero(lengths == length)
                    points = matrix(batch.take(pa.array(there)))
                    centers = net.get(int(length))
                    if centers is None:
                        away[there] = np.sqrt((points**2).sum(axis=1))
                        continue
                    far = np.stack([((points - c) ** 2).sum(axis=1) for c in centers])
                    node[there] = far.argmin(axis=0)
                    away[there] = np.sqrt(far.min(axis=0))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(node), pa.array(away)],
                    names=[*batch.schema.names, "node", "away"],
                )

    return run


def _center_pairs(spark, net: dict[int, np.ndarray]) -> DataFrame:
    """(length, a, b, dot, norm_a, norm_b) for the centers of each length, at most
    CENTERS^2 of one length; a row around the origin for lengths without centers is left
    to the join."""
    rows = []
    for length, centers in net.items():
        dots, norms = centers @ centers.T, np.sqrt((centers**2).sum(axis=1))
        rows += [
            (int(length), i, j, float(dots[i, j]), float(norms[i]), float(norms[j]))
            for i in range(len(centers))
            for j in range(len(centers))
        ]
    return spark.createDataFrame(
        rows, "length int, node int, other int, dot double, norm double, other_norm double"
    )


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, part: int = PART,
    group: int = GROUP, chunk: int = CHUNK,
) -> DataFrame:
    """The ``k`` highest inner products of each query with all other rows of ``vectors``
    (vec_id, embedding), of components floor(scale * x); ties go to the smaller id.

    Returns query_id, rank, vec_id, score.
    """
    spark = vectors.sparkSession
    slim = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.coalesce(is_query, F.lit(False)).alias("query"), "embedding",
    ).filter("vec_id IS NOT NULL")
    rows = written(
        whole_vectors(slim, scale).withColumn("uid", F.monotonically_increasing_id()), "vectors"
    )
    net = upper_net(rows, part)
    kinds = "vec_id bigint, query boolean, length int, vector binary, uid bigint"
    indexed = written(rows.mapInArrow(_assign(net), f"{kinds}, node int, away double"), "indexed")

    node = ["length", "node"]
    cuts = broadcast_if_small(
        written(
            indexed.groupBy(*node).agg(
                F.ceil(F.count(F.lit(1)) / part).alias("parts"),
                F.ceil(F.sum(F.col("query").cast("int")) / group).alias("groups"),
            ),
            "cuts",
        )
    )
    cut = indexed.join(cuts, node)
    data = cut.select(
        *node, F.pmod(F.xxhash64("uid"), "parts").alias("part"), "uid", "vec_id", "vector", "away"
    )
    asked = cut.filter("query").select(
        *node, F.pmod(F.xxhash64("uid"), "groups").alias("g"), "parts", "uid", "vec_id", "vector", "away"
    )
    blocks = written(
        data.groupBy(*node, "part").agg(F.max("away").alias("reach")), "blocks"
    )
    block = ["length", "node", "part"]
    name = F.concat_ws(":", "node", "g").alias("group")
    seeds = written(
        asked.select(
            *node, F.pmod("g", "parts").alias("part"), "uid", "vector", name,
            F.lit(None).cast("bigint").alias("floor"),
        )
        .groupBy(*block)
        .cogroup(fresh(data.select(*block, "uid", "vec_id", "vector")).groupBy(*block))
        .applyInArrow(_search(k), FOUND),
        "seeds",
    )
    kth = seeds.groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth"))
    floors = written(
        asked.join(kth, "uid", "left").withColumn("floor", F.when(F.col("n") >= k, F.col("kth"))).drop("n", "kth"),
        "queries",
    )
    groups = floors.groupBy(*node, "g", "parts").agg(
        F.max("away").alias("spread"),
        F.when(F.count("floor") == F.count(F.lit(1)), F.min("floor")).alias("worst"),
    )
    centers = _center_pairs(spark, net)
    others = blocks.select("length", F.col("node").alias("other"), F.col("part").alias("other_part"), "reach")
    # A node around the origin has no center pair: the bound is that of the radii alone.
    near = groups.filter("node >= 0").join(F.broadcast(centers), node).join(others, ["length", "other"])
    origin = (
        groups.filter("node < 0")
        .withColumns({c: F.lit(0.0) for c in ("dot", "norm", "other_norm")})
        .withColumn("other", F.lit(-1))
        .join(others, ["length", "other"])
    )
    highest = bound(F.col("dot"), F.col("norm"), F.col("spread"), F.col("other_norm"), F.col("reach"))
    met = (F.col("other") == F.col("node")) & (F.col("other_part") == F.pmod("g", "parts"))
    open_pairs = written(
        near.unionByName(origin)
        .filter(~met & (F.col("worst").isNull() | (highest >= F.col("worst"))))
        .select(*node, "g", "other", "other_part"),
        "pairs",
    )
    chunks = max(1, -(-floors.count() // chunk))
    chunk_of = F.pmod(F.xxhash64("length", "node", "g"), F.lit(chunks)).alias("chunk")
    keys = ["length", "other", "other_part", "chunk"]
    sent = floors.join(open_pairs, ["length", "node", "g"]).select(
        "length", "other", "other_part", chunk_of, "uid", "vector", name, "floor"
    )
    visited = open_pairs.select("length", "other", "other_part", chunk_of).distinct()
    seen = data.withColumnsRenamed({"node": "other", "part": "other_part"}).join(
        visited, ["length", "other", "other_part"]
    ).select(*keys, "uid", "vec_id", "vector")
    more = sent.groupBy(*keys).cogroup(fresh(seen).groupBy(*keys)).applyInArrow(_search(k), FOUND)
    order = Window.partitionBy("uid").orderBy(F.col("score").desc(), "vec_id")
    return (
        seeds.unionByName(more)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .join(floors.select("uid", F.col("vec_id").alias("query_id")), "uid")
        .select("query_id", "rank", "vec_id", "score")
    )


SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id,
    list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.e, b.e)::BIGINT AS score,
    row_number() OVER (PARTITION BY a.r ORDER BY list_inner_product(a.e, b.e) DESC, b.vec_id) AS rank
  FROM v a JOIN v b ON a.r <> b.r AND a.vec_id % 100 = 0 AND len(a.e) = len(b.e))
SELECT query_id, rank::INT AS rank, vec_id, score FROM s WHERE rank <= 10
"""


@query("op13_exact_top_k", SQL)
def op13(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)

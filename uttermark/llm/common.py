"""Helpers that several operators share: tables in the shared folder, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.
    A local one is made only where that is unset, as in tests on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="llm-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Compute ``df`` once into a table of the shared folder and read that back. Cuts the
    lineage, gives later plans a measured size, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete what ``written`` made, once later tables hold all that is needed of it."""
    for df in tables:
        context = df.sparkSession.sparkContext
        files = df.inputFiles()
        if files:
            folder = context._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64_000_000


def broadcast_if_small(
    df: DataFrame, rows: int = BROADCAST_ROWS, size: Column | None = None
) -> DataFrame:
    """``df``, a written table of narrow rows, marked for broadcast if its counted rows
    are few. Rows that hold arrays or texts of any length have a ``size`` in bytes, whose
    sum must be at most ``BROADCAST_BYTES`` too. Beyond that Spark goes by its own
    estimate, joins by shuffle, and splits skewed partitions."""
    if size is None:
        return F.broadcast(df) if df.count() <= rows else df
    n, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size.cast("bigint")), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= BROADCAST_BYTES else df


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected graph with BIGINT edges (a, b).

    Returns (node, component) for every node with an edge to another one; the component
    is its smallest node. Each round hooks every node to its smallest neighbour, follows
    the pointers to their ends by doubling, and contracts the graph to those ends, so a
    chain of n nodes takes about log n joins. Everything is joins and minima; a hub
    with very many edges is an ordinary skewed join key, which AQE splits.
    """
    left = written(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a <> b")
        .distinct(),
        "edges",
    )
    labels = None
    while not left.isEmpty():
        both = left.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            left.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        parent = written(
            both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("p")), "parents"
        )
        while True:
            up = parent.select(F.col("u").alias("_u"), F.col("p").alias("_p"))
            parent = written(
                parent.join(up, parent["p"] == up["_u"]).select(
                    "u", F.col("_p").alias("p"), (F.col("_p") < F.col("p")).alias("moved")
                ),
                "parents",
            )
            if parent.filter("moved").isEmpty():
                break
        ends = parent.select(F.col("u").alias("_u"), F.col("p").alias("_p"))
        if labels is None:
            labels = ends.select(F.col("_u").alias("node"), F.col("_p").alias("component"))
        else:
            labels = written(
                labels.join(ends, F.col("component") == F.col("_u"), "left").select(
                    "node", F.coalesce("_p", "component").alias("component")
                ),
                "labels",
            )
        first = left.join(ends, left["a"] == ends["_u"]).select(F.col("_p").alias("a"), "b")
        left = written(
            first.join(ends, first["b"] == ends["_u"])
            .select(F.greatest("a", "_p").alias("a"), F.least("a", "_p").alias("b"))
            .filter("a <> b")
            .distinct(),
            "edges",
        )
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    return labels

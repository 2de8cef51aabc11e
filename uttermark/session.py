"""Session settings the operators are designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

CLUSTER_SETTINGS = {
    # Runtime re-planning: coalesced and split partitions, joins by measured size.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A side is broadcast only if its measured size stays under this bound.
    "spark.sql.autoBroadcastJoinThreshold": "32m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32m",
    # Session windows of a hot connection shrink before the shuffle.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: int = 8, partitions: int = 8) -> SparkSession:
    """A session for tests and benches on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("uttermark")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        # Recording a call site for each column costs more than small queries take.
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # Small test tables would otherwise end up in one task after a shuffle.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    )
    for key, value in CLUSTER_SETTINGS.items():
        builder = builder.config(key, value)
    # Join the small test tables the way large ones are joined: by shuffle.
    builder = builder.config("spark.sql.autoBroadcastJoinThreshold", "1m").config(
        "spark.sql.adaptive.autoBroadcastJoinThreshold", "1m"
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

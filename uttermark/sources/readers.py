"""Readers of run directories, references, verdicts and logs.

Every reader names its schema, so no pass over the data is spent on inference, and
takes a glob, so that a date or a range of runs prunes directories before reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.grading import is_media
from ..functions.text import RUN_ID, percent_text_basis_points, run_key, to_number
from . import schemas

RUN_DIR = r"/([^/]+)/([^/]+)/[^/]+$"


def _path() -> Column:
    return F.col("_metadata.file_path")


def _run_identity() -> list[Column]:
    """Engine (the root directory), run id and its parts, all out of the path."""
    path = F.url_decode(F.replace(_path(), F.lit("+"), F.lit("%2B")))
    run_id = F.regexp_extract(path, RUN_DIR, 2)
    key = run_key(run_id)
    return [
        F.regexp_extract(path, RUN_DIR, 1).alias("engine"),
        run_id.alias("run_id"),
        # A name that is no date gives NULL and does not end the read.
        F.try_to_date(F.regexp_extract(run_id, r"^(\d{2}-\d{2}-\d{4})_v\d+$", 1), "dd-MM-yyyy").alias(
            "run_date"
        ),
        key["version"].alias("run_version"),
    ]


def _runs_only(df: DataFrame) -> DataFrame:
    """Run directories start with a digit."""
    return df.filter(F.col("run_id").rlike("^[0-9]"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """``<engine root>/<run>/results.json`` arrays, one row per element.

    ``engine`` is the root directory; what the rows themselves say is kept as
    ``reported_engine``. ``bytes_sent`` -1 (unknown) becomes NULL; ``cer_bp`` is the
    CER text as a number.
    """
    raw = spark.read.schema(schemas.RESULTS_DDL).option("multiLine", True).json(path)
    rows = raw.withColumnRenamed("engine", "reported_engine").select("*", *_run_identity())
    return _runs_only(rows).withColumns(
        {
            "bytes_sent": F.nullif("bytes_sent", F.lit(-1).cast("bigint")),
            "cer_bp": percent_text_basis_points(F.col("cer")),
        }
    )


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object ``{file: text}`` -> (file, ref_text, pos), ``pos`` being the place of
    the entry, by which the last of repeated ones is known."""
    whole = spark.read.text(path, wholetext=True)
    pairs = F.posexplode(F.from_json("value", "map<string,string>"))
    return whole.select(pairs.alias("pos", "file", "ref_text")).select("file", "ref_text", "pos")


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files -> (file, text)."""
    return spark.read.option("ignoreCorruptFiles", True).text(path, wholetext=True).select(
        F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B"))).alias("file"),
        F.col("value").alias("text"),
    )


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """``<engine root>/<run>/*.csv`` with a header, quoted line breaks and doubled quotes.
    ``line`` rises along a file, which quoted line breaks keep in one task, so that
    ``matching.last_of`` finds the last verdict."""
    raw = (
        spark.read.schema(schemas.VERDICT_DDL)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .csv(path)
    )
    line = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("line")
    numbered = raw.select("*", line, *_run_identity())
    rows = numbered.filter(F.coalesce("filename", F.lit("")) != "")
    return _runs_only(rows).withColumn(
        "has_hallucination", F.lower("has_hallucination") == "true"
    )


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(schemas.SUMMARY_DDL).option("multiLine", True).json(path)
    return _runs_only(raw.select("*", *_run_identity()))


def read_audio_quality(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.AUDIO_QUALITY_DDL).option("multiLine", True).json(path)


def parse_segments(lines: DataFrame) -> DataFrame:
    """(file, value) text lines -> (file, start, dur, speaker); short lines are dropped."""
    parts = F.split(F.trim("value"), r"\s+")
    return lines.select("file", parts.alias("p")).filter(F.size("p") >= 8).select(
        "file",
        to_number(F.col("p")[3]).alias("start"),
        to_number(F.col("p")[4]).alias("dur"),
        F.col("p")[7].alias("speaker"),
    )


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), "value")
    return parse_segments(lines)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Log lines with their place in the file: the start of their block, and their row in
    it. Places order the lines of a log; files of any size are read block by block."""
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return spark.read.text(path).select(
        F.col("_metadata.file_name").alias("log"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), row.alias("row")).alias("line_no"),
        F.col("value").alias("line"),
    )


def list_media(paths: DataFrame, path: str = "path") -> DataFrame:
    return paths.filter(is_media(F.col(path))).withColumn(
        "file", F.regexp_extract(path, "([^/]*)$", 1)
    )


def scan_media(spark: SparkSession, path: str) -> DataFrame:
    """Media files of a directory, names and sizes only (contents are not read)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return list_media(files.select("path", "length"))


def select_runs(
    df: DataFrame,
    *,
    date: str | None = None,
    low: int | None = None,
    high: int | None = None,
    runs: list[str] | None = None,
) -> DataFrame:
    """Restrict to a date (yyyy-MM-dd), an inclusive version range or a list of runs.

    With a bound set, runs whose name has no version are dropped.
    """
    if date is not None:
        df = df.filter(F.col("run_date") == F.lit(date).cast("date"))
    if low is not None or high is not None:
        df = df.filter(F.col("run_id").rlike(RUN_ID))
    if low is not None:
        df = df.filter(F.col("run_version") >= low)
    if high is not None:
        df = df.filter(F.col("run_version") <= high)
    if runs is not None:
        df = df.filter(F.col("run_id").isin(*runs))
    return df

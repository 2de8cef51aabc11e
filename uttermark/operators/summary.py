"""The summary of all runs: histograms, engine blocks and the nested document per engine.

Everything starts from few groupings of the facts. Labels of all kinds are unpivoted once
and counted per engine, file and label, which combines before the shuffle; coarser counts
are sums of these. A document is built bottom-up: maps of files and of runs, whose entries
are the rows of their grains, inside one struct per engine.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.grading import quality_tier
from . import rollup
from .bootstrap import REPLICAS
from .joins import join_null_safe
from .rollup import count_if, wilson_high, wilson_low

def label_columns() -> dict[str, Column]:
    """What is counted of a record, by the name of the histogram."""
    return {
        "status_counts": F.col("status"),
        "severity_counts": F.col("severity"),
        "primary_error_counts": F.col("primary_error"),
        "quality_tiers": quality_tier(F.col("cer_bp") / 100),
    }


def label_counts(records: DataFrame, labels: Mapping[str, Column] | None = None) -> DataFrame:
    """(engine, file, kind, label, n): all histograms of all files in one pass. A NULL label
    counts as ``unknown``."""
    labels = label_columns() if labels is None else labels
    pairs = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), F.coalesce(c.cast("string"), F.lit("unknown")).alias("label"))
            for kind, c in labels.items()
        ]
    )
    return (
        records.select("engine", "file", F.inline(pairs))
        .groupBy("engine", "file", "kind", "label")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def label_histograms(counts: DataFrame) -> DataFrame:
    """Counts per file, and their sums per engine with a NULL file."""
    engines = counts.groupBy("engine", "kind", "label").agg(F.sum("n").alias("n"))
    return counts.unionByName(engines, allowMissingColumns=True)


def count_maps(counts: DataFrame, keys: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """One map label -> n for each kind, in the order of the labels, which are few."""
    entry = F.struct("label", "n")
    totals = counts.groupBy(*keys, "kind", "label").agg(F.sum("n").alias("n"))
    return totals.groupBy(*keys).agg(
        *[
            F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == k, entry)))).alias(k)
            for k in kinds
        ]
    )


def engine_blocks(
    records: DataFrame, *, seed: int, replicas: int = REPLICAS, metrics: Mapping[str, Column] | None = None
) -> DataFrame:
    """Per engine one struct for each metric: count, mean, median, std, min, max, p95 and the
    bootstrap interval of the mean. CERs are percentages."""
    metrics = metrics or {
        "cer_all": F.col("cer_bp"),
        "cer_gt": F.when(F.col("has_timestamp"), F.col("cer_bp")),
        "rtf": F.col("inference_rtf") * 100,
    }
    long = rollup.metrics_long(records, ["engine", "seq"], metrics)
    found = rollup.metric_summary(long, ["engine", "metric"], "value", "seq", seed=seed, replicas=replicas)
    figures = ["mean", "median", "std", "min", "max", "p95", "ci_low", "ci_high"]
    block = F.struct("count", *[(F.col(c) / 100).alias(c) for c in figures])
    return found.groupBy("engine").agg(
        *[F.max(F.when(F.col("metric") == m, block)).alias(m) for m in metrics]
    )


def engine_rates(records: DataFrame) -> DataFrame:
    """Per engine the counts of records, runs and files and both rates with intervals."""
    sums = records.groupBy("engine").agg(
        F.count(F.lit(1)).alias("records"),
        count_if(F.col("has_hallucination")).alias("_k"),
        count_if(F.col("severity") == "high").alias("_h"),
    )
    n = F.col("records")
    return join_null_safe(sums, rollup.distinct_members(records), ["engine"]).select(
        "engine", "records", "runs", "files", "timestamped_files",
        *[
            column.alias(name)
            for k, rate in (("_k", "hallucination_rate"), ("_h", "high_severity_rate"))
            for name, column in (
                (rate, F.col(k) / n),
                (f"{rate}_low", wilson_low(F.col(k), n)),
                (f"{rate}_high", wilson_high(F.col(k), n)),
            )
        ],
    )


def full_engine_summary(records: DataFrame, *, seed: int, replicas: int = REPLICAS) -> DataFrame:
    """One row per engine: members, three metric blocks, rates with intervals, histograms."""
    kinds = ["status_counts", "severity_counts", "primary_error_counts"]
    maps = count_maps(label_counts(records), ["engine"], kinds)
    blocks = engine_blocks(records, seed=seed, replicas=replicas)
    joined = join_null_safe(engine_rates(records), blocks, ["engine"], "left")
    return join_null_safe(joined, maps, ["engine"])


def full_file_summary(records: DataFrame, extras: DataFrame | None = None) -> DataFrame:
    """One row per engine and file: the file grain, distinct values, the most frequent
    transcript and histograms. ``extras`` (file, and any columns that repeat on all engines:
    audio, excerpt, segments) is joined where a file has a row there."""
    keys = ["engine", "file"]
    kinds = ["severity_counts", "primary_error_counts", "quality_tiers"]
    mode = rollup.mode_by_first_seen(records, keys, "transcript_hash", "seq")
    found = join_null_safe(rollup.file_grain(records), rollup.distinct_values(records), keys)
    found = join_null_safe(found, mode.select(*keys, F.col("transcript_hash").alias("representative_hash")), keys)
    found = join_null_safe(found, count_maps(label_counts(records), keys, kinds), keys)
    return found if extras is None else found.join(extras, "file", "left")


def file_extras(
    audio: DataFrame | None = None, excerpts: DataFrame | None = None, segments: DataFrame | None = None
) -> DataFrame | None:
    """(file, audio, timestamp_excerpt, rttm) out of tables with one row per file each; those
    that are not given are left out."""
    parts = []
    if audio is not None:
        rest = [c for c in audio.columns if c != "file"]
        parts.append(audio.select("file", F.struct(*rest).alias("audio")))
    if excerpts is not None:
        parts.append(excerpts.select("file", F.col("excerpt").alias("timestamp_excerpt")))
    if segments is not None:
        parts.append(rollup.segment_stats(segments).select("file", F.struct("segments", "speakers", "voiced_seconds").alias("rttm")))
    joined = None
    for part in parts:
        joined = part if joined is None else joined.join(part, "file", "full")
    return joined


def hallucination_files(records: DataFrame) -> DataFrame:
    """Per engine and file the rates, distinct transcripts and both histograms."""
    return full_file_summary(records).select(
        "engine", "file", "hallucination_rate", "high_severity_rate", "distinct_transcript_hashes",
        "severity_counts", "primary_error_counts",
    )


FIGURE = "decimal(20,6)"


def _plain(df: DataFrame) -> DataFrame:
    """Doubles as decimals, in structs too: a document shows digits, not exponents."""

    def kind(t: str) -> str:
        return t.replace("double", FIGURE)

    return df.select(*[F.col(c).cast(kind(t)).alias(c) if "double" in t else F.col(c) for c, t in df.dtypes])


def summary_documents(
    records: DataFrame, *, seed: int, replicas: int = REPLICAS, extras: DataFrame | None = None,
    most_names: int | None = None,
) -> DataFrame:
    """(engine, document): the nested summary of each engine as JSON, with its own figures,
    its files and its runs by name, each level from the grain below. Missing figures are
    left out. The files and runs of one engine are what the document is made of, so one
    engine is one row. With ``most_names``, an engine of more files or runs has several
    documents of about so many names: each has the engine's figures, each file and run is in
    one of them, and none grows with the engine."""

    def entries(df: DataFrame, name: str, alias: str) -> DataFrame:
        rest = [c for c in df.columns if c not in ("engine", name)]
        pairs = F.array_sort(
            F.collect_list(F.struct(F.col(name).alias("key"), F.struct(*rest).alias("value"))),
            # Values hold maps, which have no order; keys are unique.
            lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1),
        )
        placed = df.withColumn("_part", F.lit(0).cast("bigint"))
        if most_names:
            place = F.pmod(F.xxhash64(name), "_parts").alias("_part")
            placed = df.join(F.broadcast(parts), "engine").select(*df.columns, place)
        return placed.groupBy("engine", "_part").agg(F.map_from_entries(pairs).alias(alias))

    # Keys of a map in a document cannot be NULL.
    named = records.withColumns(
        {c: F.coalesce(c, F.lit("unknown")) for c in ("engine", "file", "run_id")}
    )
    engines = _plain(full_engine_summary(named, seed=seed, replicas=replicas))
    own = [c for c in engines.columns if c != "engine"]
    engines = engines.select("engine", F.struct(*own).alias("engine_summary"))
    numbers = F.lit(0).cast("bigint")
    if most_names:
        # One row per engine, as are the engines themselves.
        parts = rollup.distinct_members(named).select(
            "engine", F.ceil(F.greatest("files", "runs") / most_names).alias("_parts")
        )
        engines = engines.join(parts, "engine")
        numbers = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1))
    engines = engines.select("engine", "engine_summary", numbers.alias("_part"))
    files = entries(_plain(full_file_summary(named, extras)).drop("has_timestamp"), "file", "engine_file_summary")
    runs = entries(
        _plain(
            rollup.run_summary(named).select(
                "engine", "run_id", F.col("mean_cer").alias("mean_cer_all"), "mean_cer_gt", "mean_rtf",
                "hallucination_rate",
            )
        ),
        "run_id", "engine_run_summary",
    )
    # A part may have no file or no run.
    how = "left" if most_names else "inner"
    whole = engines.join(files, ["engine", "_part"], how).join(runs, ["engine", "_part"], how)
    document = F.to_json(F.struct("engine_summary", "engine_file_summary", "engine_run_summary"))
    return whole.select("engine", document.alias("document"))

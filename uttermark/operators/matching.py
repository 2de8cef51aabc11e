"""Matching results with references, verdicts and earlier runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.grading import is_success
from ..functions.text import (
    canonical_stem, file_stem, segment_aliases, timed_aliases, transcript_hash,
)
from .joins import join_null_safe


def last_wins(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Keep the row with the greatest ``order`` per key.

    An aggregate, not a window: duplicates of a hot key vanish before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row"))
        .select(*keys, "_row.*")
    )


def match_exact(results: DataFrame, references: DataFrame) -> DataFrame:
    """Left join on the exact file name; ``references`` is (file, ref_text). Of entries that
    repeat a file the one of the greatest ``pos`` counts, as ``read_references`` numbers
    them; without that column, that of the greatest text."""
    if "pos" in references.columns:
        last = last_wins(references, ["file"], "pos").drop("pos")
    else:
        last = last_wins(references, ["file"], "ref_text")
    return results.join(last, "file", "left")


def reference_by_stem(references: DataFrame, name: str, text: str, order: str) -> DataFrame:
    """(canonical_id, text) with one row per canonical stem, the last one winning."""
    keyed = references.select(
        canonical_stem(F.col(name)).alias("canonical_id"),
        F.col(text).alias(text),
        F.col(order).alias("_order"),
    )
    return last_wins(keyed, ["canonical_id"], "_order").drop("_order")


def evaluation_candidates(results: DataFrame, timed: DataFrame, plain: DataFrame) -> DataFrame:
    """Successful, named results with their timed and plain reference, if any.

    ``timed`` is (canonical_id, gt_timestamped), ``plain`` is (canonical_id, gt_plain).
    """
    named = results.filter(is_success(F.col("status")) & (F.coalesce("file", F.lit("")) != ""))
    keyed = named.withColumn("canonical_id", canonical_stem(F.col("file")))
    return keyed.join(timed, "canonical_id", "left").join(plain, "canonical_id", "left")


def candidate_rows(matched: DataFrame) -> DataFrame:
    """Matched results in the shape that prompts are built from."""
    return matched.select(
        F.col("file").alias("filename"),
        "canonical_id",
        F.coalesce("transcript", F.lit("")).alias("hyp_transcript"),
        "gt_timestamped",
        "gt_plain",
        "duration",
        F.col("cer").alias("existing_cer"),
        F.coalesce("rf", F.lit(0)).alias("existing_rf"),
        F.col("inference_rtf").alias("existing_inference_rtf"),
    )


def with_verdicts(records: DataFrame, verdicts: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join with the defaults of a missing verdict. ``verdicts`` must be unique
    by ``on`` (see last_wins)."""
    labels = ["primary_error", "severity", "confidence", "review_status"]
    rest = [c for c in verdicts.columns if c not in [*on, *labels, "has_hallucination"]]
    return records.join(verdicts, list(on), "left").select(
        *records.columns,
        F.coalesce("has_hallucination", F.lit(False)).alias("has_hallucination"),
        *[F.coalesce(c, F.lit("unknown")).alias(c) for c in labels],
        *rest,
    )


def first_alias_match(files: DataFrame, file: str, aliases: Column, names: DataFrame) -> DataFrame:
    """(file, matched): the first of the aliases that exists in ``names`` (name).

    Works on distinct files, each with a fixed handful of aliases.
    """
    tries = files.select(file).distinct().select(file, F.posexplode(aliases).alias("_rank", "name"))
    return (
        tries.join(names.select("name").distinct(), "name")
        .groupBy(file)
        .agg(F.min_by("name", "_rank").alias("matched"))
    )


def pending(media: DataFrame, results: DataFrame, keys: Sequence[str] = ("file",)) -> DataFrame:
    """Media without a successful result yet; failed ones are tried again."""
    done = results.filter(is_success(F.col("status"))).select(*keys).distinct()
    return media.join(done, list(keys), "left_anti")


def restrict_to(df: DataFrame, allowed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(allowed.select(*keys), list(keys), "left_semi")


def missing_runs(records: DataFrame) -> DataFrame:
    """(engine, file, run_id) for every run of an engine that lacks a file of it, files
    that are in all runs left out before.

    Only what is missing is listed. Counts decide which files are incomplete; for these
    alone the runs of their engine are set against the runs seen.
    """
    pairs = records.select("engine", "file", "run_id").distinct()
    runs = pairs.select("engine", "run_id").distinct()
    totals = runs.groupBy("engine").agg(F.count(F.lit(1)).alias("_runs"))
    seen = pairs.groupBy("engine", "file").agg(F.count(F.lit(1)).alias("_seen"))
    incomplete = join_null_safe(seen, totals, ["engine"]).filter("_seen < _runs")
    wanted = join_null_safe(incomplete.select("engine", "file"), runs, ["engine"])
    return join_null_safe(wanted, pairs, ["engine", "file", "run_id"], "left_anti")


def last_of(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key without the column ``line``: that of the greatest ``line``. Rows
    that tie, or a table without that column, give the greatest row, which is at least the
    same in every run."""
    rest = F.struct(*[c for c in df.columns if c not in [*keys, "line"]])
    if "line" in df.columns:
        best = F.max(F.struct(F.col("line"), rest.alias("row"))).alias("_b")
        return df.groupBy(*keys).agg(best).select(*keys, "_b.row.*")
    return df.groupBy(*keys).agg(F.max(rest).alias("_b")).select(*keys, "_b.*")


def unified_records(
    results: DataFrame,
    verdicts: DataFrame,
    quality: DataFrame,
    timed_names: DataFrame,
    segment_names: DataFrame,
) -> DataFrame:
    """The fact table of the multi-run reports: results with their verdict of the
    same run, audio quality and marks for the references at hand.

    ``verdicts`` has (engine, run_id, filename, ...), ``quality`` has (file, ...), the
    name tables have (name) without suffix. Of repeated verdicts or quality rows the last
    counts, by a column ``line`` where the table has one.
    """
    keys = ["engine", "run_id", "file"]
    transcript = F.coalesce("transcript", F.lit(""))
    base = results.withColumns(
        {
            "transcript": transcript,
            "transcript_hash": transcript_hash(transcript),
            "transcript_length": F.length(transcript),
        }
    )
    labels = [
        "has_hallucination", "primary_error", "severity", "confidence", "review_status",
        "reasoning", "evidence_hyp_text", "evidence_gt_context",
    ]
    line = [c for c in ("line",) if c in verdicts.columns]
    judged = verdicts.select("engine", "run_id", F.col("filename").alias("file"), *labels, *line)
    one_each = last_of(judged, keys)
    sound = last_of(quality, ["file"])
    stem = file_stem(F.col("file"))
    timed = first_alias_match(base, "file", timed_aliases(stem), timed_names)
    segments = first_alias_match(base, "file", segment_aliases(stem), segment_names)
    return (
        with_verdicts(base, one_each, keys)
        .join(sound, "file", "left")
        .join(timed.withColumnRenamed("matched", "_timed"), "file", "left")
        .join(segments.withColumnRenamed("matched", "_segments"), "file", "left")
        .withColumns(
            {"has_timestamp": F.col("_timed").isNotNull(), "has_rttm": F.col("_segments").isNotNull()}
        )
        .drop("_timed", "_segments")
    )

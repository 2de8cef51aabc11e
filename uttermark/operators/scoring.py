"""Scoring results against their references."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.grading import is_success, row_grade
from ..functions.text import char_error_rate, normalize_text, percent_text, repetition_factor
from .joins import join_null_safe
from .matching import match_exact
from .rollup import silence_rate


def score_results(results: DataFrame, references: DataFrame) -> DataFrame:
    """Adds ``rf``, ``cer`` (text), ``cer_value`` and ``grade`` to every result row.

    References are matched by exact file name. ``cer`` is ``N/A`` for failed rows and
    rows without reference, ``N/A (Empty)`` for an empty hypothesis of a non-empty
    reference, and a two-decimal percent text otherwise. The silence rate that the
    grade of silence files needs is that of their run.
    """
    plain = results.drop("rf", "cer", "cer_value", "grade")
    runs = silence_rate(plain, ["engine", "run_id"])
    matched = join_null_safe(match_exact(plain, references), runs, ["engine", "run_id"], "left")
    ready = matched.withColumns(
        {
            "_hyp": normalize_text(F.col("transcript")),
            "_ref": F.when(F.col("ref_text").isNotNull(), normalize_text(F.col("ref_text"))),
            "_ok": is_success(F.coalesce("status", F.lit("success"))),
            "rf": repetition_factor(F.col("transcript")),
            "inference_rtf": F.coalesce("inference_rtf", F.lit(0.0)),
        }
    )
    empty = (F.col("_hyp") == "") & (F.col("_ref") != "")
    scored = ready.withColumn(
        "cer_value",
        F.when(
            F.col("_ok") & F.col("_ref").isNotNull() & ~empty,
            char_error_rate(F.col("_hyp"), F.col("_ref")),
        ),
    )
    cer_text = (
        F.when(F.col("cer_value").isNotNull(), percent_text(F.col("cer_value")))
        .when(F.col("_ok") & empty, "N/A (Empty)")
        .otherwise("N/A")
    )
    grade = row_grade(
        F.col("status"), F.col("file"), F.col("_hyp"), F.col("_ref"), F.col("cer_value"),
        F.col("hrs"), F.col("inference_rtf"), F.col("rf"),
    )
    return scored.withColumns({"cer": cer_text, "grade": grade}).drop(
        "_hyp", "_ref", "_ok", "hrs", "ref_text"
    )

"""Preparing judge prompts and consuming judge verdicts.

The call to the judge happens outside: prompts leave as one table, raw responses
come back as another.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import parse_cer, percent_text, round_exact
from .joins import join_null_safe
from .rollup import count_if
from .scan import BLOCK_ROWS, row_position

# The enumerations of a verdict.
PRIMARY_ERRORS = ("silence_text", "repetition", "insertion", "content_replacement", "none")
SEVERITIES = ("high", "medium", "low", "none")
CONFIDENCES = ("high", "medium", "low")
REVIEW_STATUSES = ("auto_accept", "manual_review")
OVERRIDE_NOTE = " (High CER heuristic override)"

# Model families of the second provider.
OPEN_MODEL_NAMES = ("llama", "mixtral", "deepseek", "gemma", "qwen", "gpt-oss")


@dataclass(frozen=True)
class PromptTexts:
    """Wording of the prompts; replace it to fit the judge in use."""

    timed_system: str = (
        "You assess speech recognition output. The reference has time stamps and speakers and "
        "is the source of truth. Name text the hypothesis adds, repeats or replaces. "
        "Answer with JSON only."
    )
    plain_system: str = (
        "You assess speech recognition output. The reference is plain text and is the source "
        "of truth. Name text the hypothesis adds, repeats or replaces. Answer with JSON only."
    )
    blind_system: str = (
        "You assess speech recognition output without a reference. Look for senseless "
        "repetition, a length that does not fit the duration, and sudden changes of language. "
        "Answer with JSON only."
    )
    timed_label: str = "Reference (timed):\n"
    plain_label: str = "Reference (plain text):\n"
    hypothesis_label: str = "Hypothesis:\n"
    duration_label: str = "Audio duration: "
    metrics_label: str = "Known metrics:\n"


def _filled(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def build_prompts(candidates: DataFrame, texts: PromptTexts = PromptTexts()) -> DataFrame:
    """Adds (reference_kind, system, user). An empty reference counts as none.

    Columns used: hyp_transcript, gt_timestamped, gt_plain, duration, existing_cer,
    existing_rf. The duration is told only where no reference is at hand.
    """
    timed, plain = _filled("gt_timestamped"), _filled("gt_plain")
    kind = (
        F.when(timed.isNotNull(), "timed").when(plain.isNotNull(), "plain").otherwise("none")
    )
    hyp = F.concat(F.lit(texts.hypothesis_label), F.coalesce("hyp_transcript", F.lit("")))
    body = (
        F.when(timed.isNotNull(), F.concat(F.lit(texts.timed_label), timed, F.lit("\n\n"), hyp))
        .when(plain.isNotNull(), F.concat(F.lit(texts.plain_label), plain, F.lit("\n\n"), hyp))
        .otherwise(
            F.concat(
                hyp,
                F.lit("\n\n" + texts.duration_label),
                F.coalesce(F.col("duration").cast("string"), F.lit("None")),
                F.lit("s"),
            )
        )
    )
    facts = F.concat_ws(
        "\n",
        F.concat(F.lit("CER: "), _filled("existing_cer")),
        F.when(
            F.col("existing_rf") > 0,
            F.concat(F.lit("Repetition factor: "), F.col("existing_rf").cast("string")),
        ),
    )
    context = F.when(facts != "", F.concat(F.lit("\n\n" + texts.metrics_label), facts))
    system = (
        F.when(timed.isNotNull(), texts.timed_system)
        .when(plain.isNotNull(), texts.plain_system)
        .otherwise(texts.blind_system)
    )
    return candidates.select(
        "*",
        kind.alias("reference_kind"),
        system.alias("system"),
        F.concat(body, F.coalesce(context, F.lit(""))).alias("user"),
    )


def route_provider(
    model: Column,
    available: Sequence[str],
    *,
    primary: str = "OpenAI",
    secondary: str = "Groq",
    primary_prefixes: Sequence[str] = ("gpt-",),
) -> Column:
    """Provider of a model: by prefix, else by family name, else the primary one.

    A preferred provider that is not available falls through to the next rule. Where the
    primary one is not available either, requests go to all that are in turn: NULL, for
    ``assign_round_robin`` to fill.
    """
    by_prefix = F.lit(False)
    for prefix in primary_prefixes:
        by_prefix = by_prefix | model.startswith(prefix)
    by_family = F.lit(False)
    for name in OPEN_MODEL_NAMES:
        by_family = by_family | F.lower(model).contains(name)
    fallback = F.lit(primary if primary in available else None).cast("string")
    return (
        F.when(by_prefix & F.lit(primary in available), primary)
        .when(by_family & F.lit(secondary in available), secondary)
        .otherwise(fallback)
    )


def assign_round_robin(
    requests: DataFrame,
    provider: str,
    seq: str,
    keys_per_provider: Mapping[str, int],
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Adds ``key_index``: requests of a provider go to its keys in turn. Requests without
    a provider go to the keys of all providers in turn, and get their provider with it."""
    placed = row_position(requests, [provider], seq, "_pos", block_rows)
    clients = [(name, i) for name, n in keys_per_provider.items() for i in range(n)]
    every = F.array(
        *[F.struct(F.lit(name).alias("name"), F.lit(i).alias("key")) for name, i in clients]
    )
    client = every[F.pmod(F.col("_pos") - 1, F.lit(len(clients))).cast("int")]
    size = F.lit(1)
    for name, n in keys_per_provider.items():
        size = F.when(F.col(provider) == name, n).otherwise(size)
    own = F.pmod(F.col("_pos") - 1, size)
    open_ = F.col(provider).isNull()
    return placed.select(
        *[
            F.coalesce(F.col(c), client["name"]).alias(c) if c == provider else F.col(c)
            for c in requests.columns
        ],
        F.when(open_, client["key"]).otherwise(own).alias("key_index"),
    )


TRUE_WORDS = ("true", "t", "yes", "y", "on", "1")
FALSE_WORDS = ("false", "f", "no", "n", "off", "0")


def parse_verdicts(responses: DataFrame, attempts: int = 3) -> DataFrame:
    """Validate raw JSON responses; whatever fails becomes the fallback verdict.

    Columns used: filename, raw (NULL for a call that never succeeded),
    existing_cer, existing_rf, existing_inference_rtf. The file name and the three
    metrics of the request always win over those in the response. A response is one JSON
    object and nothing else; texts must be texts, a label may be absent but not null, and
    the flag may be written as a word or as 0 or 1.
    """
    # Within brackets, text before or behind the object is no JSON any more.
    parsed = responses.withColumn(
        "_v", F.try_parse_json(F.concat(F.lit("["), F.col("raw"), F.lit("]")))
    )

    def place(field: str) -> str:
        return f"$[0].{field}"

    def kind(field: str) -> Column:
        """Type of a field: NULL if absent, VOID for a JSON null."""
        return F.schema_of_variant(F.try_variant_get("_v", place(field), "variant"))

    def text(field: str) -> Column:
        value = F.try_variant_get("_v", place(field), "string")
        return F.when(kind(field) == "STRING", value)

    def label(field: str, default: str) -> Column:
        return F.when(kind(field).isNull(), default).otherwise(text(field))

    word = F.lower(F.try_variant_get("_v", place("has_hallucination"), "string"))
    flag = F.when(
        kind("has_hallucination").isin("BOOLEAN", "STRING", "BIGINT"),
        F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False),
    )
    reasoning = text("reasoning")
    error = label("primary_error", "none")
    severity = label("severity", "none")
    confidence = label("confidence", "low")
    review = label("review_status", "auto_accept")
    valid = (
        F.try_variant_get("_v", "$[1]", "variant").isNull()
        & flag.isNotNull()
        & reasoning.isNotNull()
        & error.isin(*PRIMARY_ERRORS)
        & severity.isin(*SEVERITIES)
        & confidence.isin(*CONFIDENCES)
        & review.isin(*REVIEW_STATUSES)
    )
    for field in ("evidence_hyp_text", "evidence_gt_context"):
        valid = valid & F.coalesce(kind(field).isin("STRING", "VOID"), F.lit(True))
    ok = F.coalesce(valid, F.lit(False))
    failure = F.concat(
        F.lit(f"LLM call failed after {attempts} attempts: "),
        F.when(F.col("raw").isNull(), "no response").otherwise("invalid response"),
    )

    def pick(value: Column, fallback: Column) -> Column:
        return F.when(ok, value).otherwise(fallback)

    missing = F.lit(None).cast("string")
    # Out of a one-row generator, so that filters on these columns stay above it instead
    # of repeating the whole validation.
    verdict = F.struct(
        pick(flag, F.lit(False)).alias("has_hallucination"),
        pick(error, F.lit("none")).alias("primary_error"),
        pick(severity, F.lit("none")).alias("severity"),
        pick(confidence, F.lit("low")).alias("confidence"),
        pick(review, F.lit("manual_review")).alias("review_status"),
        pick(reasoning, failure).alias("reasoning"),
        pick(text("evidence_hyp_text"), missing).alias("evidence_hyp_text"),
        pick(text("evidence_gt_context"), missing).alias("evidence_gt_context"),
        (~ok).alias("call_failed"),
    )
    request = ["existing_cer", "existing_rf", "existing_inference_rtf"]
    labels = [
        "has_hallucination", "primary_error", "severity", "confidence", "review_status",
    ]
    texts = ["reasoning", "evidence_hyp_text", "evidence_gt_context", "call_failed"]
    return parsed.select("filename", *request, F.inline(F.array(verdict))).select(
        "filename", *labels, *request, *texts
    )


def apply_override(verdicts: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Send "no hallucination" verdicts with a CER above the threshold to review."""
    hit = F.coalesce(
        (parse_cer(F.col("existing_cer")) > threshold) & ~F.col("has_hallucination"), F.lit(False)
    )
    return verdicts.withColumns(
        {
            "review_status": F.when(hit, "manual_review").otherwise(F.col("review_status")),
            "reasoning": F.when(
                hit, F.concat(F.coalesce("reasoning", F.lit("")), F.lit(OVERRIDE_NOTE))
            ).otherwise(F.col("reasoning")),
        }
    )


def verdict_summary(verdicts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts, rates (4 dp), mean CER and mean RTF (3 dp) over the values present."""
    n = F.count(F.lit(1))

    def share(condition: Column) -> Column:
        return round_exact(F.coalesce(F.try_divide(count_if(condition), n), F.lit(0.0)), 4)

    return verdicts.groupBy(*keys).agg(
        n.alias("total_files"),
        share(F.col("has_hallucination")).alias("hallucination_rate"),
        share(F.col("review_status") == "manual_review").alias("manual_review_rate"),
        F.avg(parse_cer(F.col("existing_cer"))).alias("avg_cer"),
        round_exact(F.coalesce(F.avg("existing_inference_rtf"), F.lit(0.0)), 3).alias(
            "avg_inference_rtf"
        ),
        count_if(F.col("with_gt")).alias("with_gt_timestamped"),
        count_if(~F.col("with_gt")).alias("without_gt_timestamped"),
    )


def summary_document(
    verdicts: DataFrame, keys: Sequence[str], model: str, hrs: DataFrame | None = None
) -> DataFrame:
    """One nested row per run in the shape of the summary file: rates, two label
    histograms as maps and the mean metrics. ``hrs`` is (keys, hrs)."""

    def label_map(label: str, name: str) -> DataFrame:
        counts = verdicts.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"))
        # At most one entry per value of the enumeration.
        entries = F.map_from_entries(F.collect_list(F.struct(label, "_n")))
        return counts.groupBy(*keys).agg(entries.alias(name))

    rows = verdict_summary(verdicts, keys)
    for label, name in (("primary_error", "error_distribution"),
                        ("severity", "severity_distribution")):
        rows = join_null_safe(rows, label_map(label, name), keys)
    if hrs is not None:
        rows = join_null_safe(rows, hrs, keys, "left")
    else:
        rows = rows.withColumn("hrs", F.lit(0.0))
    cer_text = F.coalesce(percent_text(F.col("avg_cer")), F.lit("N/A"))
    return rows.select(
        *keys,
        F.lit(model).alias("model_used"),
        "total_files",
        F.col("total_files").alias("evaluated_files"),
        "with_gt_timestamped",
        "without_gt_timestamped",
        "hallucination_rate",
        "manual_review_rate",
        "error_distribution",
        "severity_distribution",
        F.struct(
            cer_text.alias("avg_cer"), "avg_inference_rtf", F.coalesce("hrs", F.lit(0.0)).alias("hrs")
        ).alias("existing_metrics"),
    )


def inconsistent(verdicts: DataFrame) -> DataFrame:
    """Verdicts that say "no hallucination" and still name an error or severity."""
    return verdicts.filter(
        ~F.col("has_hallucination")
        & ((F.col("primary_error") != "none") | (F.col("severity") != "none"))
    )

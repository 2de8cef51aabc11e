"""Queries around the judge: prompts, routing, verdicts, overrides, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import parse_cer
from ..operators import judge, rollup
from .bindings import JUDGED, judged, table, with_sql
from .registry import query
from .runs import rounded


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


TEXTS = judge.PromptTexts()

CANDIDATES = """WITH cand AS (
    SELECT c.conv_id, c.turn, c.text AS hyp, CASE WHEN c.turn % 3 = 0 THEN n.text END AS timed,
        CASE WHEN c.turn % 2 = 0 THEN coalesce(n.text, '') END AS plain,
        (c.turn * 4)::DOUBLE AS duration, CASE WHEN c.turn % 4 <> 0 THEN concat(c.turn, '.5%') END AS cer,
        (c.turn % 3)::INTEGER AS rf
    FROM conversations c LEFT JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1)"""


def candidates(spark, root):
    turns = table(spark, root, "conversations")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    turn = F.col("turn")
    return turns.join(after, ["conv_id", "turn"], "left").select(
        "conv_id", "turn",
        F.col("text").alias("hyp_transcript"),
        F.when(turn % 3 == 0, F.col("next")).alias("gt_timestamped"),
        F.when(turn % 2 == 0, F.coalesce("next", F.lit(""))).alias("gt_plain"),
        (turn * 4).cast("double").alias("duration"),
        F.when(turn % 4 != 0, F.concat(turn.cast("string"), F.lit(".5%"))).alias("existing_cer"),
        (turn % 3).cast("int").alias("existing_rf"),
    )


@query("prompts", CANDIDATES + f"""
, parts AS (SELECT *, CASE WHEN coalesce(timed, '') <> '' THEN 'timed' WHEN coalesce(plain, '') <> '' THEN 'plain'
        ELSE 'none' END AS kind, {_sql_text(TEXTS.hypothesis_label)} || hyp AS h,
    concat_ws(chr(10), 'CER: ' || cer, CASE WHEN rf > 0 THEN concat('Repetition factor: ', rf) END) AS facts FROM cand)
SELECT conv_id, turn, kind AS reference_kind,
    CASE kind WHEN 'timed' THEN {_sql_text(TEXTS.timed_system)} WHEN 'plain' THEN {_sql_text(TEXTS.plain_system)}
        ELSE {_sql_text(TEXTS.blind_system)} END AS system,
    sha256(CASE kind WHEN 'timed' THEN {_sql_text(TEXTS.timed_label)} || timed || chr(10) || chr(10) || h
        WHEN 'plain' THEN {_sql_text(TEXTS.plain_label)} || plain || chr(10) || chr(10) || h
        ELSE h || chr(10) || chr(10) || {_sql_text(TEXTS.duration_label)} || CAST(duration AS VARCHAR) || 's' END
        || CASE WHEN facts <> '' THEN chr(10) || chr(10) || {_sql_text(TEXTS.metrics_label)} || facts ELSE '' END)
        AS user_digest
FROM parts""")
def prompts(spark, root):
    return judge.build_prompts(candidates(spark, root)).select(
        "conv_id", "turn", "reference_kind", "system", F.sha2("user", 256).alias("user_digest")
    )


MODELS = ("gpt-4o", "Llama-3.3-70b", "openai/gpt-oss-20b", "qwen3", "own-model")
MODEL_SQL = """list_extract(['gpt-4o', 'Llama-3.3-70b', 'openai/gpt-oss-20b', 'qwen3', 'own-model'],
    (doc_id % 5 + 1)::INTEGER)"""
ROUTED = f"""WITH routed AS (SELECT doc_id, {MODEL_SQL} AS model, CASE WHEN doc_id % 5 IN (1, 2, 3) THEN 'Groq'
    ELSE 'OpenAI' END AS provider FROM documents)"""


def routed(spark, root):
    names = F.array(*[F.lit(m) for m in MODELS])
    model = F.element_at(names, (F.col("doc_id") % 5 + 1).cast("int"))
    docs = table(spark, root, "documents").select("doc_id", model.alias("model"))
    return docs.withColumn(
        "provider", judge.route_provider(F.col("model"), ["OpenAI", "Groq"])
    )


@query("provider_routes", ROUTED + """
SELECT provider, model, count(*) AS n FROM routed GROUP BY ALL""")
def provider_routes(spark, root):
    return routed(spark, root).groupBy("provider", "model").agg(F.count(F.lit(1)).alias("n"))


@query("round_robin", ROUTED + """
SELECT doc_id, provider, CAST((row_number() OVER (PARTITION BY provider ORDER BY doc_id) - 1)
    % CASE provider WHEN 'OpenAI' THEN 2 ELSE 3 END AS BIGINT) AS key_index FROM routed""")
def round_robin(spark, root):
    placed = judge.assign_round_robin(
        routed(spark, root), "provider", "doc_id", {"OpenAI": 2, "Groq": 3}
    )
    return placed.select("doc_id", "provider", F.col("key_index").cast("bigint").alias("key_index"))


RESPONSES = """WITH resp AS (
    SELECT d.doc_id, concat('doc_', d.doc_id) AS filename, d.doc_id % 8 AS kind, d.doc_id // 8 % 6 AS shape, l.quality, l.toxic,
        concat(d.n_chars % 120, '.25%') AS cer, (d.n_chars % 120 + 0.25) / 100 AS cer_value,
        (d.doc_id % 4)::INTEGER AS rf, (d.n_chars % 50) / 10.0::DOUBLE AS rtf
    FROM documents d LEFT JOIN labels l USING (doc_id)),
parsed AS (
    SELECT *, quality IS NOT NULL AND kind <> 5 AND kind <> 6 AND shape NOT IN (1, 2, 3) AS valid FROM resp),
verdicts AS (
    SELECT doc_id, filename, valid AND toxic = 1 AS has_hallucination,
        CASE WHEN valid AND toxic = 1 THEN 'insertion' ELSE 'none' END AS primary_error,
        CASE WHEN valid AND kind <> 7 THEN CASE WHEN toxic = 1 THEN 'high' ELSE 'low' END ELSE 'none' END AS severity,
        CASE WHEN valid THEN CASE WHEN quality = 1 THEN 'high' ELSE 'medium' END ELSE 'low' END AS confidence,
        CASE WHEN valid THEN 'auto_accept' ELSE 'manual_review' END AS review_status,
        cer AS existing_cer, cer_value, rf AS existing_rf, rtf AS existing_inference_rtf,
        CASE WHEN valid THEN 'because' WHEN quality IS NULL THEN 'LLM call failed after 3 attempts: no response'
            ELSE 'LLM call failed after 3 attempts: invalid response' END AS reasoning,
        NOT valid AS call_failed, doc_id % 2 = 0 AS with_gt, quality FROM parsed)"""


def responses(spark, root):
    """Raw judge answers: good ones, bad enumerations, broken JSON, missing fields
    and, for unlabelled documents, no answer at all."""
    docs = table(spark, root, "documents").select("doc_id", "n_chars")
    rows = docs.join(table(spark, root, "labels"), "doc_id", "left")
    kind, toxic = F.col("doc_id") % 8, F.col("toxic") == 1
    # Text behind the object, a null label, a number for a text, a flag as a word.
    shape = F.floor(F.col("doc_id") / 8) % 6
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    body = F.concat(
        F.when(kind == 4, "").otherwise(F.concat(F.lit('"filename":"other'), name, F.lit('",'))),
        F.lit('"has_hallucination":'),
        F.when(shape == 4, F.when(toxic, '"True"').otherwise('"no"'))
        .otherwise(F.when(toxic, "true").otherwise("false")),
        F.lit(',"primary_error":"'),
        F.when(kind == 5, "typo").when(toxic, "insertion").otherwise("none"),
        F.lit('",'),
        F.when(shape == 2, F.lit('"severity":null,')).when(kind == 7, "").otherwise(
            F.concat(F.lit('"severity":"'), F.when(toxic, "high").otherwise("low"), F.lit('",'))
        ),
        F.lit('"confidence":"'), F.when(F.col("quality") == 1, "high").otherwise("medium"),
        F.when(shape == 3, F.lit('","reasoning":5')).otherwise(F.lit('","reasoning":"because"')),
    )
    raw = F.when(kind == 6, F.concat(F.lit("Sure! {"), body)).otherwise(
        F.concat(F.lit("{"), body, F.when(shape == 1, "} So it is.").otherwise("}"))
    )
    return rows.select(
        "doc_id",
        name.alias("filename"),
        F.when(F.col("quality").isNotNull(), raw).alias("raw"),
        F.concat((F.col("n_chars") % 120).cast("string"), F.lit(".25%")).alias("existing_cer"),
        (F.col("doc_id") % 4).cast("int").alias("existing_rf"),
        ((F.col("n_chars") % 50) / 10).alias("existing_inference_rtf"),
    )


@query("parsed_verdicts", RESPONSES + """
SELECT filename, has_hallucination, primary_error, severity, confidence, review_status, existing_cer, existing_rf,
    existing_inference_rtf, reasoning, call_failed FROM verdicts""")
def parsed_verdicts(spark, root):
    return judge.parse_verdicts(responses(spark, root)).drop(
        "evidence_hyp_text", "evidence_gt_context"
    )


@query("overridden_verdicts", RESPONSES + """
SELECT filename, CASE WHEN cer_value > 0.5 AND NOT has_hallucination THEN 'manual_review' ELSE review_status END
    AS review_status, CASE WHEN cer_value > 0.5 AND NOT has_hallucination
    THEN reasoning || ' (High CER heuristic override)' ELSE reasoning END AS reasoning FROM verdicts""")
def overridden_verdicts(spark, root):
    verdicts = judge.apply_override(judge.parse_verdicts(responses(spark, root)))
    return verdicts.select("filename", "review_status", "reasoning")


@query("verdict_summary", RESPONSES + """
, final AS (SELECT *, CASE WHEN cer_value > 0.5 AND NOT has_hallucination THEN 'manual_review'
    ELSE review_status END AS review FROM verdicts)
SELECT existing_rf, count(*) AS total_files, CAST(printf('%.4f', count(*) FILTER (has_hallucination) / count(*)) AS DOUBLE) AS hallucination_rate,
    CAST(printf('%.4f', count(*) FILTER (review = 'manual_review') / count(*)) AS DOUBLE) AS manual_review_rate,
    round(avg(cer_value), 6) AS avg_cer, CAST(printf('%.3f', avg(existing_inference_rtf)) AS DOUBLE) AS avg_inference_rtf,
    count(*) FILTER (with_gt) AS with_gt_timestamped, count(*) FILTER (NOT with_gt) AS without_gt_timestamped
FROM final GROUP BY existing_rf""")
def verdict_summary(spark, root):
    verdicts = judge.apply_override(judge.parse_verdicts(responses(spark, root)))
    doc = F.regexp_extract("filename", "([0-9]+)$", 1).cast("bigint")
    summary = judge.verdict_summary(verdicts.withColumn("with_gt", doc % 2 == 0), ["existing_rf"])
    return summary.withColumn("avg_cer", F.round("avg_cer", 6))


@query("summary_documents", RESPONSES + """
, e AS (SELECT existing_rf, string_agg(concat(primary_error, '=', n), ',' ORDER BY primary_error) AS errors
    FROM (SELECT existing_rf, primary_error, count(*) AS n FROM verdicts GROUP BY ALL) GROUP BY existing_rf),
s AS (SELECT existing_rf, string_agg(concat(severity, '=', n), ',' ORDER BY severity) AS severities
    FROM (SELECT existing_rf, severity, count(*) AS n FROM verdicts GROUP BY ALL) GROUP BY existing_rf),
h AS (SELECT existing_rf, count(*) AS n, CAST(printf('%.3f', avg(existing_inference_rtf)) AS DOUBLE) AS rtf FROM verdicts GROUP BY existing_rf)
SELECT existing_rf, n AS evaluated_files, errors, severities, rtf AS avg_inference_rtf, 'm' AS model_used
FROM e JOIN s USING (existing_rf) JOIN h USING (existing_rf)""")
def summary_documents(spark, root):
    verdicts = judge.parse_verdicts(responses(spark, root)).withColumn("with_gt", F.lit(True))
    docs = judge.summary_document(verdicts, ["existing_rf"], "m")

    def text(name: str):
        pairs = F.transform(
            F.array_sort(F.map_entries(name)),
            lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
        )
        return F.array_join(pairs, ",")

    return docs.select(
        "existing_rf", "evaluated_files", text("error_distribution").alias("errors"),
        text("severity_distribution").alias("severities"),
        F.col("existing_metrics.avg_inference_rtf").alias("avg_inference_rtf"), "model_used",
    )


@query("verdict_labels", RESPONSES + """
SELECT 'primary_error' AS field, primary_error AS label, count(*) AS n FROM verdicts GROUP BY ALL
UNION ALL SELECT 'severity', severity, count(*) FROM verdicts GROUP BY ALL""")
def verdict_labels(spark, root):
    verdicts = judge.parse_verdicts(responses(spark, root))
    long = verdicts.select(
        F.inline(
            F.array(
                F.struct(F.lit("primary_error").alias("field"), F.col("primary_error").alias("label")),
                F.struct(F.lit("severity").alias("field"), F.col("severity").alias("label")),
            )
        )
    )
    return rollup.histogram(long, ["field"], "label")


@query("inconsistent_verdicts", RESPONSES + """
SELECT filename, primary_error, severity FROM verdicts
WHERE NOT has_hallucination AND (primary_error <> 'none' OR severity <> 'none')""")
def inconsistent_verdicts(spark, root):
    return judge.inconsistent(judge.parse_verdicts(responses(spark, root))).select(
        "filename", "primary_error", "severity"
    )


@query("judged_records", with_sql(*JUDGED, body="""
SELECT seq, file, has_hallucination, primary_error, severity, confidence, review_status FROM judged"""))
def judged_records(spark, root):
    return judged(spark, root).select(
        "seq", "file", "has_hallucination", "primary_error", "severity", "confidence", "review_status"
    )


@query("hallucination_by_engine", with_sql(*JUDGED, body="""
SELECT engine, count(*) AS total, round(count(*) FILTER (has_hallucination) / count(*), 6) AS hallucination_rate,
    round(count(*) FILTER (severity = 'high') / count(*), 6) AS high_severity_rate,
    count(*) FILTER (severity = 'none') AS sev_none, count(*) FILTER (severity = 'low') AS sev_low,
    count(*) FILTER (severity = 'medium') AS sev_medium, count(*) FILTER (severity = 'high') AS sev_high,
    count(*) FILTER (status = 'success') AS successes
FROM judged GROUP BY engine"""))
def hallucination_by_engine(spark, root):
    severity = F.col("severity")
    return rounded(
        judged(spark, root).groupBy("engine").agg(
            F.count(F.lit(1)).alias("total"),
            rollup.rate(F.col("has_hallucination")).alias("hallucination_rate"),
            rollup.rate(severity == "high").alias("high_severity_rate"),
            *[rollup.count_if(severity == s).alias(f"sev_{s}") for s in ("none", "low", "medium", "high")],
            rollup.count_if(F.col("status") == "success").alias("successes"),
        )
    )


@query("error_rate_vs_verdict", with_sql(*JUDGED, body="""
SELECT cer_bp // 1000 AS bucket, count(*) AS n, round(count(*) FILTER (has_hallucination) / count(*), 6) AS hallucination_rate
FROM judged WHERE cer_bp IS NOT NULL GROUP BY 1"""))
def error_rate_vs_verdict(spark, root):
    """Hallucination rate by ten-percent CER bucket, to choose the override threshold."""
    rows = judged(spark, root).filter(F.col("cer_bp").isNotNull())
    return rounded(
        rows.groupBy(F.floor(F.col("cer_bp") / 1000).alias("bucket")).agg(
            F.count(F.lit(1)).alias("n"),
            rollup.rate(F.col("has_hallucination")).alias("hallucination_rate"),
        )
    )


@query("error_rate_correlation", with_sql(*JUDGED, body="""
SELECT engine, round(covar_pop(cer_bp, has_hallucination::INT)
    / nullif(stddev_pop(cer_bp) * stddev_pop(has_hallucination::INT), 0), 6) AS correlation
FROM judged WHERE cer_bp IS NOT NULL GROUP BY engine"""))
def error_rate_correlation(spark, root):
    rows = judged(spark, root).filter(F.col("cer_bp").isNotNull())
    cer, flag = parse_cer(F.col("cer")), F.col("has_hallucination").cast("double")
    spread = F.stddev_pop(cer) * F.stddev_pop(flag)
    return rounded(
        rows.groupBy("engine").agg(
            F.try_divide(F.covar_pop(cer, flag), spread).alias("correlation")
        )
    )

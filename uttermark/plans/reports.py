"""Queries that end in checks and report rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.grading import evidence_or, winner
from ..operators import checks, compare, rollup, triage
from ..operators.superiority import superiority
from ..sources import sinks
from .bindings import (
    FILES, JUDGED, LEFT_ENGINE, RECORDS, RIGHT_ENGINE, judged, records, table, with_sql,
)
from .registry import query
from .runs import rounded
from .statistics import CASES, WORST, cases


@query("record_checks", with_sql(*JUDGED, body="""
, r AS (SELECT count(*) AS n, count(*) FILTER (cer_bp IS NULL) AS no_cer, count(*) FILTER (status = 'failed') AS failed,
    count(*) FILTER (NOT has_hallucination AND severity NOT IN ('none', 'unknown')) AS odd FROM judged)
SELECT 'cer is known' AS rule, n AS checked, no_cer AS violations FROM r
UNION ALL SELECT 'run succeeded', n, failed FROM r
UNION ALL SELECT 'verdict is consistent', n, odd FROM r
UNION ALL SELECT 'file is named', n, 0 FROM r"""))
def record_checks(spark, root):
    return checks.violations(
        judged(spark, root),
        {
            "cer is known": F.col("cer_bp").isNotNull(),
            "run succeeded": F.col("status") == "success",
            "verdict is consistent": F.col("has_hallucination") | F.col("severity").isin("none", "unknown"),
            "file is named": F.col("file") != "",
        },
    )


@query("triage_report_rows", with_sql(*FILES, body=CASES + f"""
SELECT concat('| ', engine, ' | `', file, '` | ', triggers, ' | ', printf('%.1f', cer_mean), '% | ',
    printf('%.1f', cer_std), '% | ', coalesce(printf('%.3f', rtf_mean), 'N/A'), ' | ',
    printf('%.1f', high_severity_rate * 100), '% |') AS row
FROM (SELECT * FROM cases ORDER BY {WORST} LIMIT 12)"""))
def triage_report_rows(spark, root):
    top = cases(spark, root).orderBy(*triage.worst_first()).limit(12)
    cells = {
        "Engine": F.col("engine"),
        "File": F.concat(F.lit("`"), F.col("file"), F.lit("`")),
        "Trigger": F.array_join("triggers", ", "),
        "Mean CER": sinks.percent_cell(F.col("cer_mean")),
        "Std CER": sinks.percent_cell(F.col("cer_std")),
        "Mean RTF": sinks.number_text(F.col("rtf_mean"), 3),
        "High severity": sinks.percent_cell(F.col("high_severity_rate") * 100),
    }
    return sinks.table_rows(top, cells).select("row")


@query("comparison_report_rows", with_sql(*RECORDS, body="""
, l AS (SELECT file, arg_max(status, seq) AS st, arg_max({'v': coalesce(inference_rtf, 0)}, seq).v AS v FROM records WHERE engine = 'click' GROUP BY file),
r AS (SELECT file, arg_max(status, seq) AS st, arg_max({'v': coalesce(inference_rtf, 0)}, seq).v AS v FROM records WHERE engine = 'view' GROUP BY file)
SELECT concat('| ', file, ' | ', CASE WHEN l.st = 'success' THEN printf('%.2f', l.v) ELSE 'N/A' END, ' | ',
    CASE WHEN r.st = 'success' THEN printf('%.2f', r.v) ELSE 'N/A' END, ' |') AS row
FROM l FULL JOIN r USING (file)"""))
def comparison_report_rows(spark, root):
    rows = records(spark, root)
    both = compare.compare_runs(
        rows.filter(F.col("engine") == LEFT_ENGINE), rows.filter(F.col("engine") == RIGHT_ENGINE)
    )
    cells = {
        "File": F.col("file"),
        "Left RTF": sinks.number_text(F.col("left_rtf"), 2),
        "Right RTF": sinks.number_text(F.col("right_rtf"), 2),
    }
    return sinks.table_rows(both, cells).select("row")


@query("case_studies", with_sql(*FILES, body="""
, pairs AS (SELECT l.file, count(*) FILTER (l.cer_bp < r.cer_bp) / count(*) AS p_left,
        count(*) FILTER (l.cer_bp > r.cer_bp) / count(*) AS p_right
    FROM records l JOIN records r USING (file) WHERE l.engine = 'click' AND r.engine = 'view'
        AND l.cer_bp IS NOT NULL AND r.cer_bp IS NOT NULL GROUP BY l.file),
reps AS (SELECT engine, file, arg_max(run_id, (cer_bp, run_date, run_version, seq)) FILTER (cer_bp IS NOT NULL) AS worst_run
    FROM records GROUP BY engine, file),
segs AS (SELECT conv_id AS user_id, count(*) AS segments, count(DISTINCT role) AS speakers,
    round(sum(length(text) / 16.0::DOUBLE), 6) AS voiced_seconds FROM conversations GROUP BY conv_id),
ex AS (SELECT doc_id AS user_id, array_to_string(list_slice(list_filter(list_transform(
    regexp_split_to_array(text, '\r\n|\r|\n'), lambda x: trim(x)), lambda x: x <> ''), 1, 3), ' ') AS excerpt FROM documents),
names AS (SELECT DISTINCT file, user_id FROM records),
f AS (SELECT c.engine, c.file, round(c.cer_mean, 6) AS cer_mean, round(c.cer_std, 6) AS cer_std,
    round(c.hallucination_rate, 6) AS hallucination_rate, round(o.cer_mean, 6) AS other_cer_mean
    FROM files c LEFT JOIN files o ON o.file = c.file AND o.engine <> c.engine AND o.engine IN ('click', 'view')
    WHERE c.engine IN ('click', 'view'))
SELECT f.*, CASE f.engine WHEN 'click' THEN p_right ELSE p_left END AS other_wins, CASE WHEN p_right > p_left THEN 'view' WHEN p_right < p_left THEN 'click' ELSE 'tie' END AS winner,
    worst_run, coalesce(segments, 0) AS segments, coalesce(speakers, 0) AS speakers,
    coalesce(voiced_seconds, 0) AS voiced_seconds, coalesce(nullif(excerpt, ''), 'no reference') AS excerpt
FROM f JOIN names USING (file) LEFT JOIN pairs USING (file) LEFT JOIN reps ON reps.file = f.file AND reps.engine = f.engine
LEFT JOIN segs USING (user_id) LEFT JOIN ex USING (user_id)"""))
def case_studies(spark, root):
    """One wide row per (engine, file) of both engines, as the case sections show it."""
    from ..functions.text import excerpt

    facts = judged(spark, root)
    both = facts.filter(F.col("engine").isin(LEFT_ENGINE, RIGHT_ENGINE))
    sides = rollup.file_grain(both).select(
        "engine", "file", "cer_mean", "cer_std", "hallucination_rate"
    )
    swapped = F.when(F.col("engine") == LEFT_ENGINE, RIGHT_ENGINE).otherwise(LEFT_ENGINE)
    other = sides.select(
        swapped.alias("engine"), "file", F.col("cer_mean").alias("other_cer_mean")
    )
    wins = superiority(
        both, ["file"], "cer_bp",
        left=(F.col("engine") == LEFT_ENGINE).cast("bigint"),
        right=(F.col("engine") == RIGHT_ENGINE).cast("bigint"),
    ).select("file", "p_left", "p_right")
    other_wins = F.when(F.col("engine") == LEFT_ENGINE, F.col("p_right")).otherwise(F.col("p_left"))
    worst = rollup.representatives(both).select("engine", "file", "worst_run")
    segments = rollup.segment_stats(
        table(spark, root, "conversations").select(
            F.col("conv_id").alias("file"), F.col("role").alias("speaker"),
            (F.length("text") / 16.0).alias("dur"),
        )
    ).withColumnRenamed("file", "user_id")
    excerpts = table(spark, root, "documents").select(
        F.col("doc_id").alias("user_id"), excerpt(F.col("text")).alias("excerpt")
    )
    names = facts.select("file", "user_id").distinct()
    zero = F.lit(0).cast("bigint")
    wide = (
        sides.join(names, "file").join(other, ["engine", "file"], "left")
        .join(wins, "file", "left").join(worst, ["engine", "file"], "left")
        .join(segments, "user_id", "left")
        .join(excerpts, "user_id", "left")
    )
    return rounded(
        wide.select(
            "engine", "file", "cer_mean", "cer_std", "hallucination_rate", "other_cer_mean",
            other_wins.alias("other_wins"),
            winner(F.col("p_left"), F.col("p_right"), LEFT_ENGINE, RIGHT_ENGINE).alias("winner"),
            "worst_run",
            F.coalesce("segments", zero).alias("segments"),
            F.coalesce("speakers", zero).alias("speakers"),
            F.coalesce("voiced_seconds", F.lit(0.0)).alias("voiced_seconds"),
            evidence_or(F.col("excerpt"), "no reference").alias("excerpt"),
        ),
        skip=("other_wins",),
    )


@query("file_totals", with_sql(*JUDGED, body="""
SELECT count(*) AS records, count(DISTINCT engine) AS engines, bool_and(file <> '') AS all_named,
    bool_or(status = 'failed') AS any_failed FROM judged"""))
def file_totals(spark, root):
    return judged(spark, root).agg(
        F.count(F.lit(1)).alias("records"),
        F.count_distinct("engine").alias("engines"),
        F.every(F.col("file") != "").alias("all_named"),
        F.some(F.col("status") == "failed").alias("any_failed"),
    )


@query("exported_records", with_sql(*JUDGED, body="""
SELECT engine, run_id, file, status, duration, NULL AS rf,
    CASE WHEN cer_bp IS NULL THEN 'N/A' ELSE printf('%.2f%%', cer_bp / 100) END AS cer, inference_rtf, transcript_hash,
    length(transcript)::INTEGER AS transcript_length, has_hallucination AS llm_has_hallucination,
    primary_error AS llm_primary_error, severity AS llm_severity, confidence AS llm_confidence,
    review_status AS llm_review_status, NULL AS audio_avg_rms, NULL AS audio_max_rms, NULL AS audio_avg_flatness,
    NULL AS audio_avg_centroid, NULL AS audio_avg_rolloff, has_timestamp, NULL AS has_rttm FROM judged"""))
def exported_records(spark, root):
    rows = judged(spark, root).withColumns(
        {
            "transcript_length": F.length("transcript"),
            # As stored: two decimals.
            "cer": F.when(F.col("cer_bp").isNull(), "N/A").otherwise(
                sinks.percent_cell(F.col("cer_bp") / 100, 2)
            ),
        }
    )
    return sinks.record_rows(rows)


@query("hallucination_summary", with_sql(*JUDGED, body="""
, c AS (SELECT engine, count(*)::DOUBLE AS n, count(*) FILTER (has_hallucination)::DOUBLE AS k,
    count(*) FILTER (severity = 'high')::DOUBLE AS h, count(DISTINCT file) FILTER (has_hallucination) AS files,
    count(*) FILTER (primary_error = 'insertion') AS insertion, count(*) FILTER (primary_error = 'repetition') AS repetition,
    count(*) FILTER (primary_error = 'content_replacement') AS content_replacement FROM judged GROUP BY engine),
w AS (SELECT *, 1.96::DOUBLE AS z FROM c)
SELECT engine, n::BIGINT AS total, k::BIGINT AS hallucinations, h::BIGINT AS high, files AS hallucinated_files,
    insertion, repetition, content_replacement, round(k / n, 6) AS rate, round(h / n, 6) AS high_rate,
    round(greatest(0.0, (k / n + z * z / (2 * n) - z * sqrt((k / n * (1 - k / n) + z * z / (4 * n)) / n)) / (1 + z * z / n)), 6) AS low,
    round(least(1.0, (k / n + z * z / (2 * n) + z * sqrt((k / n * (1 - k / n) + z * z / (4 * n)) / n)) / (1 + z * z / n)), 6) AS up,
    round(greatest(0.0, (h / n + z * z / (2 * n) - z * sqrt((h / n * (1 - h / n) + z * z / (4 * n)) / n)) / (1 + z * z / n)), 6) AS high_low,
    round(least(1.0, (h / n + z * z / (2 * n) + z * sqrt((h / n * (1 - h / n) + z * z / (4 * n)) / n)) / (1 + z * z / n)), 6) AS high_up
FROM w"""))
def hallucination_summary(spark, root):
    """Per engine all that the hallucination table shows: counts, errors, both intervals."""
    return rounded(rollup.hallucination_summary(judged(spark, root)))


@query("engine_summary", with_sql(*JUDGED, body="""
SELECT engine, count(*) AS records, count(*) FILTER (status = 'success') AS successes,
    count(*) FILTER (status <> 'success') AS failures, round(avg(cer_bp) / 100, 6) AS cer_mean,
    round(stddev_pop(cer_bp) / 100, 6) AS cer_std, max(cer_bp) / 100 AS cer_max,
    round(avg(inference_rtf), 6) AS rtf_mean, round(count(*) FILTER (has_hallucination) / count(*), 6) AS hallucination_rate,
    round(count(*) FILTER (severity = 'high') / count(*), 6) AS high_severity_rate,
    count(DISTINCT file) AS files, count(DISTINCT file) FILTER (has_timestamp) AS timestamped_files,
    count(DISTINCT run_id) AS runs, round(quantile_cont(cer_bp, 0.5) / 100, 6) AS cer_median,
    round(quantile_cont(cer_bp, 0.95) / 100, 6) AS cer_p95 FROM judged GROUP BY engine"""))
def engine_summary(spark, root):
    return rounded(rollup.engine_summary(judged(spark, root)))


@query("file_summary", with_sql(*FILES, body="""
, h AS (SELECT engine, file, transcript_hash, count(*) AS n, min(seq) AS first FROM judged GROUP BY ALL),
m AS (SELECT engine, file, arg_max(transcript_hash, (n, -first)) AS main_hash, max(n) AS main_hash_runs
    FROM h GROUP BY engine, file),
d AS (SELECT engine, file, count(DISTINCT coalesce(cer_bp, -1)) AS distinct_cer_values,
    count(DISTINCT transcript_hash) AS distinct_transcript_hashes, arg_min(duration, seq) AS duration,
    arg_max(run_id, (cer_bp, run_date, run_version, seq)) FILTER (cer_bp IS NOT NULL) AS worst_run,
    arg_min(run_id, (cer_bp, run_date, run_version, seq)) FILTER (cer_bp IS NOT NULL) AS best_run,
    arg_max(run_id, (run_date, run_version, seq)) AS latest_run,
    arg_max(transcript_hash, (run_date, run_version, seq)) AS latest_hash FROM judged GROUP BY engine, file)
SELECT engine, file, runs, round(cer_mean, 6) AS cer_mean, round(cer_std, 6) AS cer_std, cer_min, cer_max,
    round(rtf_mean, 6) AS rtf_mean, round(rtf_std, 6) AS rtf_std,
    round(hallucination_rate, 6) AS hallucination_rate, round(high_severity_rate, 6) AS high_severity_rate,
    tier_changes, has_timestamp, distinct_cer_values, distinct_transcript_hashes, main_hash, main_hash_runs,
    worst_run, best_run, latest_run, latest_hash, duration
FROM files JOIN d USING (engine, file) JOIN m USING (engine, file)"""))
def file_summary(spark, root):
    return rounded(rollup.file_summary(judged(spark, root)))


@query("run_summary", with_sql(*JUDGED, body="""
SELECT engine, run_id, count(*) AS records, count(*) FILTER (status = 'success') AS successes,
    round(avg(cer_bp) / 100, 6) AS mean_cer, round(avg(cer_bp) FILTER (has_timestamp) / 100, 6) AS mean_cer_gt,
    round(avg(inference_rtf), 6) AS mean_rtf, round(count(*) FILTER (has_hallucination) / count(*), 6) AS hallucination_rate,
    round(count(*) FILTER (severity = 'high') / count(*), 6) AS high_severity_rate,
    count(*) FILTER (review_status = 'manual_review') AS to_review FROM judged GROUP BY engine, run_id"""))
def run_summary(spark, root):
    return rounded(rollup.run_summary(judged(spark, root)))

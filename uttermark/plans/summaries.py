"""Queries of the whole summary: histograms, engine blocks and the nested documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import excerpt
from ..operators import summary
from .bindings import FILES, JUDGED, judged, records, table, with_sql
from .registry import query
from .runs import rounded
from .statistics import METRICS_LONG, draws_sql, mean_ci_sql

COUNTS = """
, labels AS (
    SELECT engine, file, 'status_counts' AS kind, status AS label FROM judged
    UNION ALL SELECT engine, file, 'severity_counts', severity FROM judged
    UNION ALL SELECT engine, file, 'primary_error_counts', primary_error FROM judged
    UNION ALL SELECT engine, file, 'quality_tiers', CASE WHEN cer_bp IS NULL THEN 'unknown'
        WHEN cer_bp <= 2000 THEN 'good' WHEN cer_bp <= 5000 THEN 'fair' ELSE 'poor' END FROM judged)"""


@query("label_histograms", with_sql(*JUDGED, body=COUNTS + """
SELECT engine, file, kind, label, count(*) AS n FROM labels
GROUP BY GROUPING SETS ((engine, file, kind, label), (engine, kind, label))"""))
def label_histograms(spark, root):
    """All histograms of all files and engines: statuses, severities, errors, tiers."""
    return summary.label_histograms(summary.label_counts(judged(spark, root))).select(
        "engine", "file", "kind", "label", "n"
    )


BLOCK = """count(*) FILTER (metric = '{0}') AS {0}_count,
    round(avg(value) FILTER (metric = '{0}') / 100, 6) AS {0}_mean,
    round(quantile_cont(value, 0.5) FILTER (metric = '{0}') / 100, 6) AS {0}_median,
    round(stddev_pop(value) FILTER (metric = '{0}') / 100, 6) AS {0}_std,
    round(min(value) FILTER (metric = '{0}') / 100, 6) AS {0}_min, round(max(value) FILTER (metric = '{0}') / 100, 6) AS {0}_max,
    round(quantile_cont(value, 0.95) FILTER (metric = '{0}') / 100, 6) AS {0}_p95,
    round(any_value(ci_low) FILTER (metric = '{0}') / 100, 6) AS {0}_ci_low,
    round(any_value(ci_high) FILTER (metric = '{0}') / 100, 6) AS {0}_ci_high"""
METRICS = ("cer_all", "cer_gt", "rtf")
WILSON = """round({2}({3}, ({0} / n + z * z / (2 * n) {1} z * sqrt(({0} / n * (1 - {0} / n) + z * z / (4 * n)) / n))
    / (1 + z * z / n)), 6)"""


@query("engine_metric_blocks", with_sql(*JUDGED, body=METRICS_LONG
       + draws_sql("long", "engine, metric", 101) + mean_ci_sql("engine, metric") + f"""
, blocks AS (SELECT engine, {', '.join(BLOCK.format(m) for m in METRICS)}
    FROM long JOIN ci USING (engine, metric) GROUP BY engine),
c AS (SELECT engine, count(*)::DOUBLE AS n, count(*) FILTER (has_hallucination)::DOUBLE AS k,
    count(*) FILTER (severity = 'high')::DOUBLE AS h, count(DISTINCT file) AS files,
    count(DISTINCT file) FILTER (has_timestamp) AS timestamped_files, count(DISTINCT run_id) AS runs,
    1.96::DOUBLE AS z, count(*) FILTER (status = 'success') AS successes,
    count(*) FILTER (status = 'failed') AS failures FROM judged GROUP BY engine)
SELECT blocks.*, n::BIGINT AS records, files, timestamped_files, runs, successes, failures,
    round(k / n, 6) AS hallucination_rate, round(h / n, 6) AS high_severity_rate,
    {WILSON.format('k', '-', 'greatest', '0.0')} AS hallucination_rate_low, {WILSON.format('k', '+', 'least', '1.0')} AS hallucination_rate_high,
    {WILSON.format('h', '-', 'greatest', '0.0')} AS high_severity_rate_low, {WILSON.format('h', '+', 'least', '1.0')} AS high_severity_rate_high
FROM blocks JOIN c USING (engine)"""))
def engine_metric_blocks(spark, root):
    """The engine grain whole: members, three metric blocks, statuses, rates with intervals."""
    whole = summary.full_engine_summary(judged(spark, root), seed=101)
    figures = ["count", "mean", "median", "std", "min", "max", "p95", "ci_low", "ci_high"]
    flat = whole.select(
        "engine", "records", "files", "timestamped_files", "runs",
        *[c for c in whole.columns if "rate" in c],
        *[
            F.coalesce(F.col("status_counts")[s], F.lit(0).cast("bigint")).alias(name)
            for s, name in (("success", "successes"), ("failed", "failures"))
        ],
        *[F.col(m)[f].alias(f"{m}_{f}") for m in METRICS for f in figures],
    )
    return rounded(flat)


def extras_of(spark, root):
    """Excerpts and segments of the given tables, by the file that they belong to."""
    names = records(spark, root).select("file", "user_id").distinct()
    turns = table(spark, root, "conversations").select(
        F.col("conv_id").alias("user_id"), F.col("role").alias("speaker"), (F.length("text") / 16.0).alias("dur")
    )
    texts = table(spark, root, "documents").select(
        F.col("doc_id").alias("user_id"), excerpt(F.col("text")).alias("excerpt")
    )
    return summary.file_extras(
        excerpts=names.join(texts, "user_id").select("file", "excerpt"),
        segments=names.join(turns, "user_id").select("file", "speaker", "dur"),
    )


def _map(kind: str, keys: str) -> str:
    return f"""(SELECT {keys}, string_agg('"' || label || '":' || n, ',' ORDER BY label) AS m FROM
        (SELECT {keys}, label, count(*) AS n FROM labels WHERE kind = '{kind}' GROUP BY {keys}, label) GROUP BY {keys})"""


def _figure(name: str, value: str) -> str:
    return f""" || coalesce(',"{name}":' || printf('%.6f', {value}), '')"""


@query("file_documents", with_sql(*FILES, body=COUNTS + f"""
, h AS (SELECT engine, file, transcript_hash, count(*) AS n, min(seq) AS first FROM judged GROUP BY ALL),
m AS (SELECT engine, file, arg_max(transcript_hash, (n, -first)) AS main_hash FROM h GROUP BY engine, file),
d AS (SELECT engine, file, count(DISTINCT coalesce(cer_bp, -1)) AS cers, count(DISTINCT transcript_hash) AS hashes
    FROM judged GROUP BY engine, file),
t AS (SELECT f.engine, f.file, concat('{{"runs":', f.runs{_figure('cer_mean', 'f.cer_mean')}{_figure('cer_std', 'f.cer_std')}
    {_figure('cer_min', 'f.cer_min')}{_figure('cer_max', 'f.cer_max')}
    {_figure('hallucination_rate', 'f.hallucination_rate')}{_figure('high_severity_rate', 'f.high_severity_rate')},
    ',"tier_changes":', f.tier_changes, ',"distinct_cer_values":', d.cers, ',"distinct_transcript_hashes":', d.hashes,
    ',"representative_hash":"', m.main_hash, '","severity_counts":{{', s.m, '}},"primary_error_counts":{{', p.m,
    '}},"quality_tiers":{{', q.m, '}}}}') AS text
  FROM files f JOIN d USING (engine, file) JOIN m USING (engine, file)
  JOIN {_map('severity_counts', 'engine, file')} s USING (engine, file)
  JOIN {_map('primary_error_counts', 'engine, file')} p USING (engine, file)
  JOIN {_map('quality_tiers', 'engine, file')} q USING (engine, file))
SELECT engine, '{{' || string_agg('"' || file || '":' || text, ',' ORDER BY file) || '}}' AS files FROM t GROUP BY engine"""))
def file_documents(spark, root):
    """The files of each engine as one nested text, out of the summary document."""
    documents = summary.summary_documents(judged(spark, root), seed=101, replicas=2)
    # RTFs are sums of doubles, whose sixth digit may depend on their order.
    return documents.select(
        "engine",
        F.regexp_replace(
            F.regexp_extract("document", r'"engine_file_summary":(.*),"engine_run_summary"', 1),
            r',"rtf_(mean|std)":[0-9.]+', "",
        ).alias("files"),
    )


@query("summary_leaves", with_sql(*JUDGED, body="""
, c AS (SELECT engine, count(*) AS records, count(DISTINCT file) AS files, count(DISTINCT run_id) AS runs FROM judged GROUP BY engine),
r AS (SELECT engine, run_id, round(avg(cer_bp) / 100, 6) AS mean_cer_all, round(avg(cer_bp) FILTER (has_timestamp) / 100, 6) AS mean_cer_gt,
    round(count(*) FILTER (has_hallucination) / count(*), 6) AS hallucination_rate FROM judged GROUP BY engine, run_id)
SELECT engine, run_id, mean_cer_all, mean_cer_gt, hallucination_rate, records, files, runs FROM r JOIN c USING (engine)"""))
def summary_leaves(spark, root):
    """The summary documents read back: one row per run, with figures of its engine."""
    documents = summary.summary_documents(
        judged(spark, root), seed=101, replicas=2, extras=extras_of(spark, root), most_names=2048
    )
    run = "struct<mean_cer_all:double, mean_cer_gt:double, hallucination_rate:double>"
    shape = f"engine_summary struct<records:bigint, files:bigint, runs:bigint>, engine_run_summary map<string,{run}>"
    read = documents.select("engine", F.from_json("document", shape).alias("d"))
    return rounded(
        read.select("engine", "d.engine_summary.*", F.explode("d.engine_run_summary").alias("run_id", "r")).select(
            "engine", "run_id", "r.*", "records", "files", "runs"
        )
    )

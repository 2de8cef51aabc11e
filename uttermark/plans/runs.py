"""Queries over runs: means, statistics, selection, comparison, resumption."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.grading import is_media
from ..functions.text import clock_text, run_key, verdict_cell
from ..operators import compare, matching, rollup, runlog, stability
from ..sources.readers import list_media, select_runs
from .bindings import (
    JUDGED, LEFT_ENGINE, RECORDS, RIGHT_ENGINE, judged, records, table, with_sql,
)
from .registry import query

OK_MEANS = """
    SELECT engine, run_id, avg(coalesce(total_rtf, 0)) AS avg_total_rtf,
        avg(coalesce(inference_rtf, 0)) AS avg_inference_rtf, avg(cer_bp) / 10000 AS avg_cer
    FROM records WHERE status = 'success' GROUP BY engine, run_id"""


def rounded(df, digits: int = 6, skip: tuple = ()):
    """Round the DOUBLE columns, whose last bits depend on the order of addition."""
    return df.select(
        *[
            F.round(c, digits).alias(c) if t == "double" and c not in skip else F.col(c)
            for c, t in df.dtypes
        ]
    )


@query("run_means", with_sql(*RECORDS, body=f"""
SELECT engine, run_id, round(avg_total_rtf, 6) AS avg_total_rtf,
    round(avg_inference_rtf, 6) AS avg_inference_rtf, round(avg_cer, 6) AS avg_cer
FROM ({OK_MEANS})"""))
def run_means(spark, root):
    return rounded(rollup.run_means(records(spark, root)))


@query("mean_of_run_means", with_sql(*RECORDS, body=f"""
SELECT engine, p.runs_passed, m.runs_aggregated, round(m.rtf_total, 6) AS avg_total_rtf,
    round(m.rtf_inf, 6) AS avg_inference_rtf, round(m.cer, 6) AS avg_cer
FROM (SELECT engine, count(DISTINCT run_id) AS runs_passed FROM records GROUP BY engine) p
JOIN (SELECT engine, count(*) AS runs_aggregated, avg(avg_total_rtf) AS rtf_total,
        avg(avg_inference_rtf) AS rtf_inf, avg(avg_cer) AS cer
      FROM ({OK_MEANS}) GROUP BY engine) m USING (engine)"""))
def mean_of_run_means(spark, root):
    return rounded(rollup.mean_of_run_means(records(spark, root)))


@query("run_statistics", with_sql(*RECORDS, body="""
SELECT engine, run_id, count(*) AS total_files, count(*) FILTER (status = 'success') AS success_count,
    round(avg(coalesce(total_rtf, 0)) FILTER (status = 'success'), 6) AS avg_total_rtf,
    round(avg(coalesce(inference_rtf, 0)) FILTER (status = 'success'), 6) AS avg_inference_rtf,
    round(avg(connect_time) FILTER (status = 'success'), 6) AS avg_connect_time,
    round(avg(stream_time) FILTER (status = 'success'), 6) AS avg_stream_time,
    round(avg(wait_after_commit) FILTER (status = 'success'), 6) AS avg_wait_after_commit,
    round(avg(cer_bp) FILTER (status = 'success') / 10000, 6) AS avg_cer
FROM records GROUP BY engine, run_id HAVING count(*) FILTER (status = 'success') > 0"""))
def run_statistics(spark, root):
    return rounded(rollup.run_statistics(records(spark, root)))


@query("batch_averages", with_sql(*RECORDS, body="""
SELECT run_id, count(*) AS done, count(*) FILTER (status = 'failed') AS failed,
    round(avg(coalesce(total_rtf, 0)) FILTER (status = 'success'), 6) AS avg_total_rtf,
    round(avg(coalesce(inference_rtf, 0)) FILTER (status = 'success'), 6) AS avg_inference_rtf
FROM records GROUP BY run_id"""))
def batch_averages(spark, root):
    ok = F.col("status") == "success"
    return rounded(
        records(spark, root).groupBy("run_id").agg(
            F.count(F.lit(1)).alias("done"),
            rollup.count_if(F.col("status") == "failed").alias("failed"),
            F.avg(F.when(ok, rollup.zero_if_missing("total_rtf"))).alias("avg_total_rtf"),
            F.avg(F.when(ok, rollup.zero_if_missing("inference_rtf"))).alias("avg_inference_rtf"),
        )
    )


@query("run_selection", with_sql(*RECORDS, body="""
SELECT engine, run_id, run_version, count(*) AS n FROM records
WHERE run_date = DATE '2024-01-05' AND run_version BETWEEN 1 AND 1
GROUP BY engine, run_id, run_version"""))
def run_selection(spark, root):
    chosen = select_runs(records(spark, root), date="2024-01-05", low=1, high=1)
    return chosen.groupBy("engine", "run_id", "run_version").agg(F.count(F.lit(1)).alias("n"))


LISTED = ("05-01-2024_v1", "07-01-2024_v2", "01-01-1999_v1")


@query("listed_runs", with_sql(*RECORDS, body=f"""
SELECT engine, run_id, count(*) AS n FROM records WHERE run_id IN {LISTED} GROUP BY engine, run_id"""))
def listed_runs(spark, root):
    """A fixed list of runs, one of which does not exist."""
    chosen = select_runs(records(spark, root), runs=list(LISTED))
    return chosen.groupBy("engine", "run_id").agg(F.count(F.lit(1)).alias("n"))


@query("runs_in_order", with_sql(*RECORDS, body="""
SELECT engine, run_id, CAST(rank() OVER (PARTITION BY engine ORDER BY run_date, run_version) AS INTEGER)
    AS position
FROM (SELECT DISTINCT engine, run_id, run_date, run_version FROM records)"""))
def runs_in_order(spark, root):
    from pyspark.sql import Window

    # One row per run is left when the window starts.
    runs = records(spark, root).select("engine", "run_id").distinct()
    order = Window.partitionBy("engine").orderBy(run_key(F.col("run_id")))
    return runs.select("engine", "run_id", F.rank().over(order).alias("position"))


@query("latest_run", with_sql(*RECORDS, body="""
SELECT engine, arg_max(run_id, (run_date, run_version)) AS latest_run FROM records GROUP BY engine"""))
def latest_run(spark, root):
    return rollup.latest_run(records(spark, root))


@query("compare_runs", with_sql(*RECORDS, body="""
, last AS (
    SELECT engine, file, arg_max(status, seq) AS status,
        arg_max({'v': coalesce(inference_rtf, 0)}, seq).v AS rtf,
        arg_max({'v': cer_bp / 100}, seq).v AS cer
    FROM records GROUP BY engine, file),
l AS (SELECT file, CASE WHEN status = 'success' THEN rtf END AS left_rtf,
        CASE WHEN status = 'success' THEN cer END AS left_cer FROM last WHERE engine = 'click'),
r AS (SELECT file, CASE WHEN status = 'success' THEN rtf END AS right_rtf,
        CASE WHEN status = 'success' THEN cer END AS right_cer FROM last WHERE engine = 'view')
SELECT file, left_rtf, left_cer, right_rtf, right_cer, round(left_rtf - right_rtf, 6) AS rtf_diff,
    round(left_cer - right_cer, 6) AS cer_diff
FROM l FULL JOIN r USING (file)"""))
def compare_runs(spark, root):
    rows = records(spark, root)
    both = compare.compare_runs(
        rows.filter(F.col("engine") == LEFT_ENGINE), rows.filter(F.col("engine") == RIGHT_ENGINE)
    )
    return both.withColumns(
        {"rtf_diff": F.round("rtf_diff", 6), "cer_diff": F.round("cer_diff", 6)}
    )


@query("compare_histograms", with_sql(*JUDGED, body="""
, l AS (SELECT primary_error, count(*) AS n FROM judged WHERE engine = 'click' GROUP BY 1),
r AS (SELECT primary_error, count(*) AS n FROM judged WHERE engine = 'view' GROUP BY 1)
SELECT primary_error, coalesce(l.n, 0) AS n_left, coalesce(r.n, 0) AS n_right,
    coalesce(l.n, 0) - coalesce(r.n, 0) AS diff
FROM l FULL JOIN r USING (primary_error)"""))
def compare_histograms(spark, root):
    rows = judged(spark, root)
    return compare.compare_histograms(
        rows.filter(F.col("engine") == LEFT_ENGINE), rows.filter(F.col("engine") == RIGHT_ENGINE),
        "primary_error",
    )


@query("last_wins", with_sql(*RECORDS, body="""
SELECT engine, run_id, file, arg_max(seq, seq) AS seq, arg_max(status, seq) AS status
FROM records GROUP BY engine, run_id, file"""))
def last_wins(spark, root):
    rows = records(spark, root).select("engine", "run_id", "file", "seq", "status")
    return matching.last_wins(
        rows.withColumn("_order", F.col("seq")), ["engine", "run_id", "file"], "_order"
    ).drop("_order")


@query("pending_files", with_sql(*RECORDS, body="""
SELECT DISTINCT engine, run_id, file FROM records r WHERE NOT EXISTS (
    SELECT 1 FROM records d WHERE d.status = 'success' AND d.engine = r.engine
        AND d.run_id = r.run_id AND d.file = r.file)"""))
def pending_files(spark, root):
    rows = records(spark, root).select("engine", "run_id", "file", "status")
    keys = ["engine", "run_id", "file"]
    return matching.pending(rows.select(*keys).distinct(), rows, keys)


@query("missing_runs", with_sql(*RECORDS, body="""
, grid AS (SELECT DISTINCT f.engine, f.file, r.run_id FROM records f JOIN records r USING (engine))
SELECT engine, file, run_id FROM grid g WHERE NOT EXISTS (SELECT 1 FROM records r
    WHERE r.engine = g.engine AND r.file = g.file AND r.run_id = g.run_id)"""))
def missing_runs(spark, root):
    return matching.missing_runs(records(spark, root))


@query("timed_files_only", with_sql(*RECORDS, body="""
SELECT engine, run_id, count(*) AS n, avg(cer_bp) / 100 AS mean_cer_timed
FROM records WHERE file IN (SELECT file FROM records WHERE has_timestamp) GROUP BY engine, run_id"""))
def timed_files_only(spark, root):
    rows = records(spark, root)
    timed = rows.filter("has_timestamp").select("file").distinct()
    return matching.restrict_to(rows, timed, ["file"]).groupBy("engine", "run_id").agg(
        F.count(F.lit(1)).alias("n"), (F.avg("cer_bp") / 100).alias("mean_cer_timed")
    )


FIELDS = ("status", "cer", "inference_rtf", "transcript", "has_timestamp", "run_version")


@query("field_stability", with_sql(*RECORDS, body="""
, long AS (
    SELECT engine, file, 'status' AS field, status AS text FROM records
    UNION ALL SELECT engine, file, 'cer', coalesce(CAST(cer_bp AS VARCHAR), 'None') FROM records
    UNION ALL SELECT engine, file, 'inference_rtf', coalesce(CAST(inference_rtf AS VARCHAR), 'None') FROM records
    UNION ALL SELECT engine, file, 'transcript', transcript FROM records
    UNION ALL SELECT engine, file, 'has_timestamp', CAST(has_timestamp AS VARCHAR) FROM records
    UNION ALL SELECT engine, file, 'run_version', CAST(run_version AS VARCHAR) FROM records),
per AS (SELECT engine, file, field, count(DISTINCT text) AS n FROM long GROUP BY ALL)
SELECT field, count(*) FILTER (n = 1) AS identical_count, count(*) FILTER (n > 1) AS different_count,
    CASE WHEN count(*) FILTER (n > 1) = 0 THEN 'PERFECTLY STABLE' ELSE 'VOLATILE' END AS status
FROM per GROUP BY field"""))
def field_stability(spark, root):
    return stability.field_stability(records(spark, root), ["engine", "file"], FIELDS)


@query("stability_conclusion", with_sql(*RECORDS, body="""
, per AS (
    SELECT count(DISTINCT status) AS a, count(DISTINCT coalesce(CAST(cer_bp AS VARCHAR), 'None')) AS b,
        count(DISTINCT has_timestamp) AS c FROM records GROUP BY engine, file)
SELECT max(a) = 1 AND max(b) = 1 AND max(c) = 1 AS completely_identical,
    CAST((max(a) = 1)::INT + (max(b) = 1)::INT + (max(c) = 1)::INT AS BIGINT) AS stable_fields,
    CAST((max(a) > 1)::INT + (max(b) > 1)::INT + (max(c) > 1)::INT AS BIGINT) AS volatile_fields
FROM per"""))
def stability_conclusion(spark, root):
    return stability.conclusion(
        stability.field_stability(
            records(spark, root), ["engine", "file"], ("status", "cer", "has_timestamp")
        )
    )


@query("pivot_runs", with_sql(*JUDGED, body="""
SELECT engine, file, run_id, arg_max(concat(CASE WHEN has_hallucination THEN 'H' ELSE 'OK' END,
    ' (', CASE WHEN cer_bp IS NULL THEN 'none' ELSE CAST(cer_bp AS VARCHAR) END, ')'), seq) AS cell
FROM judged GROUP BY engine, file, run_id"""))
def pivot_runs(spark, root):
    """The cells of the run table in long form, so that no run is left out."""
    cer = F.coalesce(F.col("cer_bp").cast("string"), F.lit("none"))
    cell = verdict_cell(F.col("has_hallucination"), cer)
    return stability.run_cells(judged(spark, root), ["engine", "file"], "run_id", cell, "seq")


@query("run_stability", with_sql(*RECORDS, body="""
, runs AS (SELECT engine, run_id, avg(cer_bp) / 100 AS c, avg(inference_rtf) AS r
    FROM records GROUP BY engine, run_id)
SELECT engine, count(*) AS runs, round(avg(c), 6) AS cer_mean, round(stddev_pop(c), 6) AS cer_std,
    round(avg(r), 6) AS rtf_mean, round(stddev_pop(r), 6) AS rtf_std, min(c) = max(c) AS cer_constant,
    CASE WHEN min(c) = max(c) THEN 'constant over runs' ELSE 'varies between runs' END AS note
FROM runs GROUP BY engine"""))
def run_stability(spark, root):
    from ..functions.grading import variation_note

    rows = rollup.run_stability(records(spark, root))
    note = variation_note(F.when(F.col("cer_constant"), 0).otherwise(1))
    return rounded(rows).withColumn("note", note)


@query("media_files", """
SELECT CASE doc_id % 5 WHEN 0 THEN concat('audio/', source, '/Doc ', doc_id, '.MP3')
        WHEN 1 THEN concat('audio/', doc_id, '.wav') WHEN 2 THEN concat('audio/', doc_id, '.txt')
        WHEN 3 THEN concat('audio/a.b/', doc_id) ELSE concat('audio/', doc_id, '.flac') END AS path,
    CASE doc_id % 5 WHEN 0 THEN concat('Doc ', doc_id, '.MP3') WHEN 1 THEN concat(doc_id, '.wav')
        ELSE concat(doc_id, '.flac') END AS file
FROM documents WHERE doc_id % 5 IN (0, 1, 4)""")
def media_files(spark, root):
    n, source = F.col("doc_id").cast("string"), F.col("source")
    kind = F.col("doc_id") % 5
    path = (
        F.when(kind == 0, F.concat(F.lit("audio/"), source, F.lit("/Doc "), n, F.lit(".MP3")))
        .when(kind == 1, F.concat(F.lit("audio/"), n, F.lit(".wav")))
        .when(kind == 2, F.concat(F.lit("audio/"), n, F.lit(".txt")))
        .when(kind == 3, F.concat(F.lit("audio/a.b/"), n))
        .otherwise(F.concat(F.lit("audio/"), n, F.lit(".flac")))
    )
    return list_media(table(spark, root, "documents").select(path.alias("path")))


@query("run_dir_from_log", """
SELECT user_id AS log, arg_max(concat('results/run_', event_id), event_id) AS run_dir
FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY user_id""")
def run_dir_from_log(spark, root):
    n = F.col("event_id").cast("string")
    line = (
        F.when(F.col("event_type") == "signup", F.concat(F.lit("New batch run: results/run_"), n))
        .when(F.col("event_type") == "purchase",
              F.concat(F.lit("  Resuming batch in: results/run_"), n, F.lit("  ")))
        .otherwise(F.concat(F.lit("progress "), n))
    )
    lines = table(spark, root, "events").select(
        F.col("user_id").alias("log"), F.col("event_id").alias("line_no"), line.alias("line")
    )
    return runlog.run_dir_from_log(lines, ["log"], "line_no")


@query("log_tail", """
SELECT event_id AS line_no, event_type AS line FROM events ORDER BY event_id DESC LIMIT 60""")
def log_tail(spark, root):
    lines = table(spark, root, "events").select(
        F.col("event_id").alias("line_no"), F.col("event_type").alias("line")
    )
    return runlog.tail(lines, "line_no")


@query("log_fields", """
SELECT event_id AS line_no, strftime(ts, '%H:%M:%S.%g') AS clock, concat('c', user_id) AS conn,
    event_type AS event, regexp_extract(props, '[0-9]+') AS k
FROM events""")
def log_fields(spark, root):
    from ..functions.text import log_line, parse_log_line

    message = F.concat(
        F.col("event_type"), F.lit("  k="), F.get_json_object("props", "$.k"), F.lit("  x=1")
    )
    line = log_line(clock_text(F.col("ts")), F.concat(F.lit("c"), F.col("user_id").cast("string")),
                    message)
    parsed = table(spark, root, "events").select(
        F.col("event_id").alias("line_no"), parse_log_line(line).alias("p")
    )
    return parsed.select("line_no", "p.clock", "p.conn", "p.event", F.col("p.fields")["k"].alias("k"))


@query("next_version", """
WITH used AS (SELECT DISTINCT CAST(ts AS DATE) AS day, user_id + 1 AS v FROM events),
cand AS (SELECT day, v + 1 AS v FROM used UNION SELECT day, 1 FROM used)
SELECT strftime(day, '%Y-%m-%d') AS day, min(v) AS next_version,
    concat(strftime(day, '%d-%m-%Y'), '_v', min(v)) AS run_id
FROM cand c WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.day = c.day AND u.v = c.v)
GROUP BY day""")
def next_version(spark, root):
    from ..functions.text import run_id_of

    used = table(spark, root, "events").select(
        F.to_date("ts").alias("d"), (F.col("user_id") + 1).alias("v")
    )
    return runlog.next_version(used, "d", "v").select(
        F.date_format("d", "yyyy-MM-dd").alias("day"),
        "next_version",
        run_id_of(F.col("d"), F.col("next_version")).alias("run_id"),
    )


@query("batch_position", with_sql(*RECORDS, body="""
SELECT engine, run_id, seq,
    row_number() OVER (PARTITION BY engine, run_id ORDER BY seq) AS position,
    count(*) OVER (PARTITION BY engine, run_id) AS total
FROM records"""))
def batch_position(spark, root):
    from ..operators.scan import running

    one = F.lit(1).cast("bigint")
    return running(
        records(spark, root).select("engine", "run_id", "seq"), ["engine", "run_id"], "seq",
        sums={"position": one}, totals={"total": one},
    )

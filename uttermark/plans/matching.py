"""Queries that match results with references by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import canonical_stem, file_stem, segment_aliases, timed_aliases
from ..operators import matching
from .bindings import JUDGED, file_verdicts, records, table, with_sql
from .registry import query

RESULTS = """WITH results AS (
    SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN concat('Doc ', doc_id, ' (1).mp3')
            WHEN 1 THEN concat('Doc ', doc_id, '_(1).mp3') ELSE concat('Doc ', doc_id, '.mp3') END AS file,
        CASE WHEN doc_id % 11 = 0 THEN 'failed' ELSE 'success' END AS status,
        lang, n_chars FROM documents)"""


def results(spark, root):
    n, kind = F.col("doc_id").cast("string"), F.col("doc_id") % 3
    tail = (
        F.when(kind == 0, " (1).mp3").when(kind == 1, "_(1).mp3").otherwise(".mp3")
    )
    return table(spark, root, "documents").select(
        "doc_id",
        F.concat(F.lit("Doc "), n, tail).alias("file"),
        F.when(F.col("doc_id") % 11 == 0, "failed").otherwise("success").alias("status"),
        "lang", "n_chars",
    )


@query("match_exact", RESULTS + """
SELECT r.doc_id, r.file, g.item_id AS ref_item, length(g.text) AS ref_chars FROM results r
LEFT JOIN benchmark g ON r.file = concat('Doc ', g.item_id * 3, ' (1).mp3')""")
def match_exact(spark, root):
    refs = table(spark, root, "benchmark").select(
        F.concat(F.lit("Doc "), (F.col("item_id") * 3).cast("string"), F.lit(" (1).mp3")).alias("file"),
        F.col("text").alias("ref_text"), F.col("item_id").alias("ref_item"),
    )
    return matching.match_exact(results(spark, root), refs).select(
        "doc_id", "file", "ref_item", F.length("ref_text").cast("bigint").alias("ref_chars")
    )


@query("evaluation_candidates", RESULTS + """
, timed AS (SELECT concat('doc_', doc_id, '_1') AS id, arg_max(quality, quality) AS q
    FROM labels GROUP BY 1),
plain AS (SELECT CASE WHEN item_id % 2 = 0 THEN concat('doc_', item_id * 3, '_1')
        ELSE concat('doc_', item_id * 3 + 2) END AS id, arg_max(item_id, item_id) AS item
    FROM benchmark GROUP BY 1),
keyed AS (SELECT *, CASE WHEN doc_id % 3 = 2 THEN concat('doc_', doc_id)
    ELSE concat('doc_', doc_id, '_1') END AS canonical_id FROM results WHERE status = 'success')
SELECT doc_id, canonical_id, CASE WHEN t.id IS NOT NULL THEN concat('quality ', q) END AS gt_timestamped,
    CASE WHEN p.id IS NOT NULL THEN concat('item ', item) END AS gt_plain
FROM keyed k LEFT JOIN timed t ON t.id = k.canonical_id LEFT JOIN plain p ON p.id = k.canonical_id""")
def evaluation_candidates(spark, root):
    labels = table(spark, root, "labels").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("_(1).txt")).alias("name"),
        F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("gt_timestamped"),
        "quality",
    )
    item = F.col("item_id")
    plain = table(spark, root, "benchmark").select(
        F.when(item % 2 == 0, F.concat(F.lit("DOC "), (item * 3).cast("string"), F.lit("-(1).wav")))
        .otherwise(F.concat(F.lit("x/Doc__"), (item * 3 + 2).cast("string"), F.lit("_.mp3")))
        .alias("name"),
        F.concat(F.lit("item "), item.cast("string")).alias("gt_plain"), "item_id",
    )
    return matching.evaluation_candidates(
        results(spark, root),
        matching.reference_by_stem(labels, "name", "gt_timestamped", "quality"),
        matching.reference_by_stem(plain, "name", "gt_plain", "item_id"),
    ).select("doc_id", "canonical_id", "gt_timestamped", "gt_plain")


@query("timed_alias_lookup", RESULTS + """
, names AS (SELECT CASE WHEN doc_id % 2 = 0 THEN concat('Doc ', doc_id, '_(1)')
    ELSE concat('Doc ', doc_id, ' (1)') END AS name FROM labels),
tries AS (SELECT DISTINCT file, unnest([stem, replace(stem, ' (1)', '_(1)'), replace(stem, '_(1)', ' (1)')]) AS name,
        unnest([0, 1, 2]) AS rank FROM (SELECT file, replace(file, '.mp3', '') AS stem FROM results))
SELECT file, arg_min(name, rank) AS matched FROM tries JOIN names USING (name) GROUP BY file""")
def timed_alias_lookup(spark, root):
    n = F.col("doc_id").cast("string")
    names = table(spark, root, "labels").select(
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Doc "), n, F.lit("_(1)")))
        .otherwise(F.concat(F.lit("Doc "), n, F.lit(" (1)"))).alias("name")
    )
    aliases = timed_aliases(file_stem(F.col("file")))
    return matching.first_alias_match(results(spark, root), "file", aliases, names)


@query("segment_alias_lookup", RESULTS + """
, names AS (SELECT concat('Doc ', doc_id) AS name FROM labels),
tries AS (SELECT DISTINCT file, unnest([stem, replace(stem, ' (1)', ''), replace(stem, '_(1)', '')]) AS name,
        unnest([0, 1, 2]) AS rank FROM (SELECT file, replace(file, '.mp3', '') AS stem FROM results))
SELECT file, arg_min(name, rank) AS matched FROM tries JOIN names USING (name) GROUP BY file""")
def segment_alias_lookup(spark, root):
    names = table(spark, root, "labels").select(
        F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("name")
    )
    aliases = segment_aliases(file_stem(F.col("file")))
    return matching.first_alias_match(results(spark, root), "file", aliases, names)


@query("union_of_engines", """
SELECT engine, count(*) AS n, count(delay_ms) AS with_delay, count(profile) AS with_profile FROM (
    SELECT event_type AS engine, user_id AS delay_ms, NULL AS profile FROM events WHERE event_type = 'click'
    UNION ALL SELECT event_type, NULL, 'raw' FROM events WHERE event_type <> 'click') GROUP BY engine""")
def union_of_engines(spark, root):
    events = table(spark, root, "events").withColumnRenamed("event_type", "engine")
    first = events.filter("engine = 'click'").select("engine", F.col("user_id").alias("delay_ms"))
    second = events.filter("engine <> 'click'").select("engine", F.lit("raw").alias("profile"))
    both = first.unionByName(second, allowMissingColumns=True)
    return both.groupBy("engine").agg(
        F.count(F.lit(1)).alias("n"), F.count("delay_ms").alias("with_delay"),
        F.count("profile").alias("with_profile"),
    )


@query("distinct_stems", RESULTS + """
SELECT DISTINCT CASE WHEN doc_id % 3 = 2 THEN concat('doc_', doc_id) ELSE concat('doc_', doc_id, '_1') END
    AS stem FROM results""")
def distinct_stems(spark, root):
    return results(spark, root).select(canonical_stem(F.col("file")).alias("stem")).distinct()


@query("unified_records", with_sql(*JUDGED, body="""
, names AS (SELECT seq, user_id, engine, run_id, file, transcript_hash, length(transcript) AS transcript_length FROM records)
SELECT seq, n.engine, n.run_id, n.file, transcript_hash, transcript_length::INTEGER AS transcript_length,
    coalesce(v.has_hallucination, FALSE) AS has_hallucination, coalesce(v.severity, 'unknown') AS severity,
    CASE WHEN v.user_id IS NOT NULL THEN concat('seen ', v.severity) END AS reasoning,
    CASE WHEN n.user_id % 4 = 0 THEN n.user_id / 100.0::DOUBLE END AS avg_rms,
    n.user_id % 10 > 3 AS has_timestamp, n.user_id % 10 > 1 AND n.user_id % 3 = 0 AS has_rttm
FROM names n LEFT JOIN verdicts v USING (user_id)"""))
def unified_records(spark, root):
    """Every verdict and quality row comes twice, a wrong one first; timed references and
    segments are stored under their aliases."""
    rows = records(spark, root)
    user, number = F.col("user_id"), F.col("user_id").cast("string")
    labels = file_verdicts(spark, root)
    right = (
        rows.select("engine", "run_id", F.col("file").alias("filename"), "user_id").distinct()
        .join(labels, "user_id")
        .withColumns(
            {
                "line": F.lit(2),
                "reasoning": F.concat(F.lit("seen "), F.col("severity")),
                "evidence_hyp_text": F.lit(""),
                "evidence_gt_context": F.lit(None).cast("string"),
            }
        )
    )
    wrong = right.withColumns(
        {"line": F.lit(1), "has_hallucination": F.lit(True), "severity": F.lit("medium"),
         "reasoning": F.lit("zzz")}
    )
    files = rows.select("file", "user_id").distinct()
    quality = files.filter(user % 4 == 0).select(
        "file", F.explode(F.array(F.lit(1), F.lit(2))).alias("line"), (user / 100).alias("avg_rms")
    ).withColumn("avg_rms", F.when(F.col("line") == 1, 999.0).otherwise(F.col("avg_rms")))
    media = files.filter(user % 10 > 1)
    timed = media.filter(user % 10 > 3).select(
        F.concat(F.lit("media_"), number, F.when(user % 2 == 0, " (1)").otherwise("_(1)")).alias("name")
    )
    segments = media.filter(user % 3 == 0).select(F.concat(F.lit("media_"), number).alias("name"))
    found = matching.unified_records(
        rows.drop("has_timestamp"), right.unionByName(wrong), quality, timed, segments
    )
    return found.select(
        "seq", "engine", "run_id", "file", "transcript_hash", "transcript_length",
        "has_hallucination", "severity", "reasoning", "avg_rms", "has_timestamp", "has_rttm",
    )

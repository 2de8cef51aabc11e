"""Queries over sample arrays and speaker segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grading, signal
from ..operators import rollup
from ..sources.readers import parse_segments
from .bindings import table
from .registry import query
from .runs import rounded

CHUNK = 16


@query("pcm_chunks", """
WITH samples AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
pcm AS (SELECT vec_id, i // 16 AS chunk, trunc((x * 32767::FLOAT)::FLOAT)::BIGINT AS v FROM samples)
SELECT vec_id, chunk::INTEGER AS chunk, count(*)::INTEGER AS n, sum(v)::BIGINT AS total, min(v)::BIGINT AS low,
    max(v)::BIGINT AS high FROM pcm GROUP BY vec_id, chunk""")
def pcm_chunks(spark, root):
    pcm = signal.to_int16(F.col("embedding"))
    rows = table(spark, root, "embeddings").select(
        "vec_id", F.posexplode(signal.chunks(pcm, CHUNK)).alias("chunk", "samples")
    )
    total = F.aggregate("samples", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.select(
        "vec_id", "chunk", F.size("samples").alias("n"), total.alias("total"),
        F.array_min("samples").cast("bigint").alias("low"),
        F.array_max("samples").cast("bigint").alias("high"),
    )


@query("pcm_round_trip", """
SELECT vec_id, round(max(abs(x - trunc((x * 32767::FLOAT)::FLOAT)::BIGINT / 32767.0)), 6) AS worst_error,
    count(*) AS samples FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY vec_id""")
def pcm_round_trip(spark, root):
    text = F.array_join(F.transform(signal.to_int16(F.col("embedding")), lambda x: x.cast("string")), ",")
    rows = table(spark, root, "embeddings").select(
        "vec_id", "embedding", F.base64(F.encode(text, "utf-8")).alias("audio")
    )
    decoded = F.split(F.decode(F.unbase64("audio"), "utf-8"), ",")
    back = F.transform(decoded, lambda s: s.cast("double") / signal.FULL_SCALE)
    errors = F.zip_with("embedding", back, lambda a, b: F.abs(a.cast("double") - b))
    return rows.select(
        "vec_id",
        F.round(F.array_max(errors), 6).alias("worst_error"),
        F.size("embedding").cast("bigint").alias("samples"),
    )


SIGNAL_SQL = """WITH samples AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
pairs AS (SELECT *, lead(x) OVER (PARTITION BY vec_id, i // 16 ORDER BY i) AS nx FROM samples),
frames AS (SELECT vec_id, i // 16 AS f, sqrt(sum(x * x) / count(*)) AS rms,
    count(*) FILTER ((x < 0) <> (nx < 0)) / count(*) AS zcr FROM pairs GROUP BY ALL),
s AS (SELECT vec_id, avg(rms) AS avg_rms, max(rms) AS max_rms, avg(zcr) AS avg_zcr FROM frames GROUP BY vec_id)"""


def signal_summary_of(spark, root):
    frames = table(spark, root, "embeddings").select(
        "vec_id", "label", F.explode(signal.chunks(F.col("embedding"), CHUNK)).alias("frame")
    )
    return frames.groupBy("vec_id").agg(
        F.avg(signal.frame_rms(F.col("frame"))).alias("avg_rms"),
        F.max(signal.frame_rms(F.col("frame"))).alias("max_rms"),
        F.avg(signal.zero_crossing_rate(F.col("frame"))).alias("avg_zcr"),
    )


@query("signal_summary", SIGNAL_SQL + """
SELECT vec_id, round(avg_rms, 6) AS avg_rms, round(max_rms, 6) AS max_rms, round(avg_zcr, 6) AS avg_zcr FROM s""")
def signal_summary(spark, root):
    return rounded(signal_summary_of(spark, root))


@query("audio_reasons", SIGNAL_SQL + """
SELECT vec_id, array_to_string(list_filter([CASE WHEN avg_rms / 12 < 0.01 THEN 'âm thanh bị nhỏ (low volume)' END,
    CASE WHEN max_rms / 2 > 0.1 OR avg_zcr / 3 > 0.15 THEN 'âm thanh bị rè (noisy/distorted)' END,
    CASE WHEN vec_id % 9 * 1000 < 4000 THEN 'bandwidth hẹp (low bandwidth)' END], lambda x: x IS NOT NULL), '; ') AS reasons
FROM s""")
def audio_reasons(spark, root):
    s = signal_summary_of(spark, root)
    reasons = grading.audio_reasons(
        F.col("avg_rms") / 12, F.col("max_rms") / 2, F.col("avg_zcr") / 3, F.col("vec_id") % 9 * 1000
    )
    return s.select("vec_id", F.array_join(reasons, "; ").alias("reasons"))


@query("segment_stats", """
SELECT CASE WHEN conv_id % 2 = 0 THEN 'even.rttm' ELSE concat('conv_', conv_id, '.rttm') END AS file, count(*) AS segments,
    count(DISTINCT role) AS speakers, round(sum(CASE WHEN turn <> 1 THEN length(text) / 16.0::DOUBLE ELSE 0.0 END), 6) AS voiced_seconds
FROM conversations WHERE turn <> 3 GROUP BY 1""")
def segment_stats(spark, root):
    """Half of all segments lie in one file here; lines of turn 3 are too short to
    count, and the duration of turn 1 is no number."""
    conv, turn = F.col("conv_id"), F.col("turn")
    name = F.when(conv % 2 == 0, "even.rttm").otherwise(
        F.concat(F.lit("conv_"), conv.cast("string"), F.lit(".rttm"))
    )
    dur = F.when(turn == 1, "n/a").otherwise((F.length("text") / 16.0).cast("string"))
    line = F.concat_ws(
        " ", F.lit(" SPEAKER"), name, F.lit("1"), (turn * 10).cast("string"), dur,
        F.lit("<NA> <NA>"), F.when(turn != 3, F.col("role")), F.when(turn != 3, "<NA> <NA>"),
    )
    lines = table(spark, root, "conversations").select(name.alias("file"), line.alias("value"))
    return rounded(rollup.segment_stats(parse_segments(lines)))

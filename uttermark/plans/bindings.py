"""The given tables seen through the engine's schemas.

Each view exists twice: as a DataFrame and as the SQL text of the same rows, which
the checks against a second engine start from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import percent_text_basis_points, run_id_of, transcript_hash
from ..operators.matching import with_verdicts

LEFT_ENGINE, RIGHT_ENGINE = "click", "view"


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def with_sql(*views: str, body: str) -> str:
    """SQL text with the named views, each one after those it reads."""
    return "WITH " + ",\n".join(f"{v} AS ({VIEWS[v].strip()})" for v in views) + "\n" + body


# ------------------------------------------------------------------- records


def file_name(user: Column) -> Column:
    number = user.cast("string")
    return (
        F.when(user % 10 == 0, F.concat(F.lit("silence_"), number, F.lit(".wav")))
        .when(user % 10 == 1, F.concat(F.lit("White_Noise_"), number, F.lit(".flac")))
        .otherwise(F.concat(F.lit("media_"), number, F.lit(" (1).mp3")))
    )


def records(spark: SparkSession, root: str) -> DataFrame:
    """Result rows as the result files hold them: one per event, the CER as text."""
    events = table(spark, root, "events").withColumn(
        "k", F.get_json_object("props", "$.k").cast("int")
    )
    k = F.col("k")
    version = (F.floor(F.hour("ts") / 12) + 1).cast("int")
    cer_text = F.when(k < 90, F.concat(F.col("value").cast("string"), F.lit("%"))).otherwise("N/A")
    base = events.select(
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("engine"),
        "user_id",
        file_name(F.col("user_id")).alias("file"),
        F.to_date("ts").alias("run_date"),
        version.alias("run_version"),
        run_id_of(F.col("ts"), version).alias("run_id"),
        "k",
        F.when(k < 10, "failed").otherwise("success").alias("status"),
        cer_text.alias("cer"),
        F.when(k % 7 != 0, k / 50).alias("inference_rtf"),
        ((k + 5) / 50).alias("total_rtf"),
        (k / 1000).alias("connect_time"),
        (k / 4).alias("stream_time"),
        F.col("value").alias("wait_after_commit"),
        k.cast("double").alias("duration"),
        F.when(k < 10, "").otherwise(
            F.concat(F.lit("take "), F.floor(k / 20).cast("string"))
        ).alias("transcript"),
        (F.col("user_id") % 10 > 3).alias("has_timestamp"),
    )
    return base.withColumn("cer_bp", percent_text_basis_points(F.col("cer"))).withColumn(
        "transcript_hash", transcript_hash(F.col("transcript"))
    )


def file_verdicts(spark: SparkSession, root: str) -> DataFrame:
    """Judge labels per file, out of the quality and toxicity labels."""
    bad, toxic = F.col("quality") == 0, F.col("toxic") == 1
    return table(spark, root, "labels").select(
        F.col("doc_id").alias("user_id"),
        (bad | toxic).alias("has_hallucination"),
        F.when(toxic & bad, "content_replacement").when(toxic, "insertion")
        .when(bad, "repetition").otherwise("none").alias("primary_error"),
        F.when(toxic & bad, "high").when(toxic, "medium").when(bad, "low")
        .otherwise("none").alias("severity"),
        F.when(bad, "low").otherwise("high").alias("confidence"),
        F.when(toxic, "manual_review").otherwise("auto_accept").alias("review_status"),
    )


def judged(spark: SparkSession, root: str) -> DataFrame:
    """Records with their verdict, the fact table of the multi-run reports."""
    return with_verdicts(records(spark, root), file_verdicts(spark, root), ["user_id"])


def big_records(spark: SparkSession, root: str) -> DataFrame:
    """Order lines as result rows: a larger fact table with hot engines."""
    return table(spark, root, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        F.col("l_returnflag").alias("engine"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("file"),
        F.date_format("l_shipdate", "yyyy-MM").alias("run_id"),
        F.round(F.col("l_discount") * 100000 + F.col("l_quantity")).cast("bigint").alias("cer_bp"),
        (F.round(F.col("l_tax") * 2500) / 100).alias("inference_rtf"),
        (F.col("l_linestatus") == "F").alias("has_hallucination"),
        F.when(F.col("l_quantity") > 45, "high").otherwise("none").alias("severity"),
        (F.col("l_suppkey") % 10 > 3).alias("has_timestamp"),
    )


# ------------------------------------------------------------------- texts


def turn_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Each conversation turn as hypothesis of the turn before it (an equi-join on
    conversation and turn)."""
    turns = table(spark, root, "conversations")
    hyp = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp"))
    ref = turns.select("conv_id", "turn", F.col("text").alias("ref"))
    return hyp.join(ref, ["conv_id", "turn"]).select(
        "conv_id", "turn", "hyp", "ref"
    )


# ---------------------------------------------------------------- messages


def _message(kind: str, *fields: Column) -> Column:
    head = F.lit('{"type":"' + kind + '"')
    return F.concat(head, *fields, F.lit("}"))


def _events(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").select(
        F.col("user_id").alias("conn_id"),
        F.col("event_id").alias("seq"),
        "ts",
        "event_type",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def buffered_messages(spark: SparkSession, root: str) -> DataFrame:
    """Append/commit protocol; a chunk has 2k bytes of audio as base64."""
    k = F.col("k").cast("string")
    audio = F.base64(F.encode(F.repeat(F.lit("ab"), F.col("k")), "utf-8"))
    session = F.concat(
        F.lit(',"session":{"transcription_delay_ms":'), k,
        F.when(F.col("k") % 2 == 0, F.concat(F.lit(',"temperature":0.'), k, F.lit("5"))).otherwise(""),
        F.lit("}"),
    )
    kind = F.col("event_type")
    payload = (
        F.when(kind == "click", _message("input_audio_buffer.append",
                                         F.lit(',"audio":"'), audio, F.lit('"')))
        .when(kind == "view", _message("session.keepalive"))
        .when(kind == "purchase", _message("input_audio_buffer.commit"))
        .when(kind == "signup", _message("session.update", session))
        .otherwise(_message("error", F.lit(',"error":{"message":"code '), k, F.lit('"}')))
    )
    return _typed(_events(spark, root).select("conn_id", "seq", "ts", payload.alias("payload")))


def dialog_messages(spark: SparkSession, root: str) -> DataFrame:
    """Config/audio/partial/final protocol with all places a text can hide in."""
    k = F.col("k").cast("string")

    def texts(tag: str, lead: str, second: str) -> Column:
        return F.concat(
            F.lit(f',"{tag}":[{{"text":"{lead} '), k, F.lit(f'"}},{{"text":"{second}"}}]')
        )

    def text(lead: str) -> Column:
        return F.concat(F.lit(f',"text":"{lead} '), k, F.lit('"'))

    kind, empty = F.col("event_type"), F.lit(',"text":""')
    partial = (
        F.when(F.col("k") % 3 == 0, texts("lines", "p", "")).when(F.col("k") % 3 == 1, text("q"))
        .otherwise(empty)
    )
    final = (
        F.when(F.col("k") % 4 == 0, text("f"))
        .when(F.col("k") % 4 == 1, F.concat(empty, texts("lines", "a", "b")))
        .when(F.col("k") % 4 == 2, texts("segments", "s", "t"))
        .otherwise(empty)
    )
    audio = F.base64(F.encode(F.repeat(F.lit("ab"), F.col("k")), "utf-8"))
    payload = (
        F.when(kind == "signup", _message("config"))
        .when(kind == "click", _message("audio", F.lit(',"audio":"'), audio, F.lit('"')))
        .when(kind == "view", _message("partial", partial))
        .when(kind == "purchase", _message("final", final))
        .otherwise(_message("error", F.lit(',"message":"bad '), k, F.lit('"')))
    )
    return _typed(_events(spark, root).select("conn_id", "seq", "ts", payload.alias("payload")))


def _typed(messages: DataFrame) -> DataFrame:
    from ..streaming.messages import message_type

    return messages.select("conn_id", "seq", "ts", message_type(F.col("payload")).alias("type"), "payload")


# -------------------------------------------------------------------- SQL

K = "CAST(regexp_extract(props, '[0-9]+') AS INTEGER)"

VIEWS = {
    "records": f"""
        SELECT *, CASE WHEN status = 'failed' THEN '' ELSE concat('take ', k // 20) END AS transcript,
            substr(sha256(CASE WHEN status = 'failed' THEN '' ELSE concat('take ', k // 20) END), 1, 12)
                AS transcript_hash
        FROM (
            SELECT event_id AS seq, event_type AS engine, user_id,
                CASE WHEN user_id % 10 = 0 THEN concat('silence_', user_id, '.wav')
                     WHEN user_id % 10 = 1 THEN concat('White_Noise_', user_id, '.flac')
                     ELSE concat('media_', user_id, ' (1).mp3') END AS file,
                CAST(ts AS DATE) AS run_date,
                CAST(hour(ts) // 12 + 1 AS INTEGER) AS run_version,
                concat(strftime(ts, '%d-%m-%Y'), '_v', hour(ts) // 12 + 1) AS run_id,
                {K} AS k,
                CASE WHEN {K} < 10 THEN 'failed' ELSE 'success' END AS status,
                CASE WHEN {K} < 90 THEN CAST(round(value * 100) AS BIGINT) END AS cer_bp,
                CASE WHEN {K} % 7 <> 0 THEN {K} / 50.0::DOUBLE END AS inference_rtf,
                ({K} + 5) / 50.0::DOUBLE AS total_rtf,
                {K} / 1000.0::DOUBLE AS connect_time,
                {K} / 4.0::DOUBLE AS stream_time,
                value AS wait_after_commit,
                {K}::DOUBLE AS duration,
                user_id % 10 > 3 AS has_timestamp
            FROM events)""",
    "verdicts": """
        SELECT doc_id AS user_id, (quality = 0 OR toxic = 1) AS has_hallucination,
            CASE WHEN toxic = 1 AND quality = 0 THEN 'content_replacement'
                 WHEN toxic = 1 THEN 'insertion' WHEN quality = 0 THEN 'repetition'
                 ELSE 'none' END AS primary_error,
            CASE WHEN toxic = 1 AND quality = 0 THEN 'high' WHEN toxic = 1 THEN 'medium'
                 WHEN quality = 0 THEN 'low' ELSE 'none' END AS severity,
            CASE WHEN quality = 0 THEN 'low' ELSE 'high' END AS confidence,
            CASE WHEN toxic = 1 THEN 'manual_review' ELSE 'auto_accept' END AS review_status
        FROM labels""",
    "judged": """
        SELECT r.*, coalesce(v.has_hallucination, FALSE) AS has_hallucination,
            coalesce(v.primary_error, 'unknown') AS primary_error,
            coalesce(v.severity, 'unknown') AS severity,
            coalesce(v.confidence, 'unknown') AS confidence,
            coalesce(v.review_status, 'unknown') AS review_status
        FROM records r LEFT JOIN verdicts v USING (user_id)""",
    "big": """
        SELECT l_orderkey * 8 + l_linenumber AS seq, l_returnflag AS engine,
            concat('s', l_suppkey) AS file, strftime(l_shipdate, '%Y-%m') AS run_id,
            CAST(round(l_discount * 100000 + l_quantity) AS BIGINT) AS cer_bp,
            round(l_tax * 2500) / 100 AS inference_rtf, l_linestatus = 'F' AS has_hallucination,
            CASE WHEN l_quantity > 45 THEN 'high' ELSE 'none' END AS severity,
            l_suppkey % 10 > 3 AS has_timestamp
        FROM lineitem""",
    "pairs": r"""
        SELECT r.conv_id, r.turn, h.text AS hyp, r.text AS ref
        FROM conversations r JOIN conversations h ON h.conv_id = r.conv_id AND h.turn = r.turn + 1""",
    "messages": f"""
        SELECT user_id AS conn_id, event_id AS seq, ts, {K} AS k,
            CASE event_type WHEN 'click' THEN 'input_audio_buffer.append'
                WHEN 'view' THEN 'session.keepalive' WHEN 'purchase' THEN 'input_audio_buffer.commit'
                WHEN 'signup' THEN 'session.update' ELSE 'error' END AS type
        FROM events""",
    "dialog": f"""
        SELECT user_id AS conn_id, event_id AS seq, ts, {K} AS k,
            CASE event_type WHEN 'click' THEN 'audio' WHEN 'view' THEN 'partial'
                WHEN 'purchase' THEN 'final' WHEN 'signup' THEN 'config' ELSE 'error' END AS type
        FROM events""",
    "units": """
        SELECT *, coalesce(sum(CASE WHEN type = 'input_audio_buffer.commit' THEN 1 ELSE 0 END) OVER (
            PARTITION BY conn_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            AS unit
        FROM messages""",
    "attempts": """
        SELECT *, CAST(coalesce(sum(CASE WHEN type IN ('final', 'error') THEN 1 ELSE 0 END) OVER (
            PARTITION BY conn_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            AS BIGINT) AS attempt
        FROM dialog""",
    "files": """
        SELECT engine, file, count(*) AS runs, avg(cer_bp) / 100 AS cer_mean,
            stddev_pop(cer_bp) / 100 AS cer_std, min(cer_bp) / 100 AS cer_min,
            max(cer_bp) / 100 AS cer_max, avg(inference_rtf) AS rtf_mean,
            stddev_pop(inference_rtf) AS rtf_std,
            count(*) FILTER (has_hallucination) / count(*) AS hallucination_rate,
            count(*) FILTER (severity = 'high') / count(*) AS high_severity_rate,
            min(tier) <> max(tier) AS tier_changes, bool_or(has_timestamp) AS has_timestamp
        FROM (SELECT *, CASE WHEN cer_bp IS NULL THEN 'unknown' WHEN cer_bp <= 2000 THEN 'good'
                WHEN cer_bp <= 5000 THEN 'fair' ELSE 'poor' END AS tier FROM judged)
        GROUP BY engine, file""",
}

RECORDS = ("records",)
JUDGED = ("records", "verdicts", "judged")
FILES = (*JUDGED, "files")

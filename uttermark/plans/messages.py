"""Queries over message streams, in their batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import messages as m
from .bindings import buffered_messages, dialog_messages, with_sql
from .registry import query

BUFFERED = ("messages",)
UNITS = ("messages", "units")
DIALOG = ("dialog",)
ATTEMPTS = ("dialog", "attempts")

SECONDS = "(epoch_us({1}) - epoch_us({0})) / 1e6"


def _r(x: str, digits: int) -> str:
    """Rounds the exact binary value of a double, exact ties to even."""
    return f"CAST(printf('%.{digits}f', {x}) AS DOUBLE)"


@query("message_types", with_sql(*BUFFERED, body="""
SELECT type, count(*) AS n, TRUE AS known FROM messages GROUP BY type"""))
def message_types(spark, root):
    return m.type_counts(buffered_messages(spark, root))


@query("unknown_message_types", with_sql(*DIALOG, body="""
SELECT type, count(*) AS n, type = 'error' AS known FROM dialog GROUP BY type"""))
def unknown_message_types(spark, root):
    return m.type_counts(dialog_messages(spark, root))


@query("commit_units", with_sql(*UNITS, body="""
SELECT conn_id, unit::BIGINT AS unit, count(*) FILTER (type LIKE '%append') AS chunks,
    coalesce(sum(2 * k) FILTER (type LIKE '%append'), 0)::BIGINT AS bytes,
    count(*) FILTER (type = 'session.keepalive') AS keepalives, max(seq) FILTER (type LIKE '%commit') AS commit_seq
FROM units GROUP BY conn_id, unit HAVING count(*) FILTER (type LIKE '%commit') > 0"""))
def commit_units(spark, root):
    return m.commit_units(buffered_messages(spark, root))


@query("running_counters", with_sql(*BUFFERED, body="""
SELECT conn_id, seq, 2 * k::BIGINT AS chunk_bytes,
    row_number() OVER w AS chunks_sent, (sum(2 * k) OVER w)::BIGINT AS bytes_sent
FROM messages WHERE type LIKE '%append' WINDOW w AS (PARTITION BY conn_id ORDER BY seq ROWS UNBOUNDED PRECEDING)"""))
def running_counters(spark, root):
    return m.running_counters(buffered_messages(spark, root))


@query("session_settings", with_sql(*BUFFERED, body="""
, sent AS (SELECT conn_id, seq, 'transcription_delay_ms' AS setting, CAST(k AS VARCHAR) AS value
        FROM messages WHERE type = 'session.update'
    UNION ALL SELECT conn_id, seq, 'temperature', concat('0.', k, '5') FROM messages WHERE type = 'session.update' AND k % 2 = 0
    UNION ALL SELECT DISTINCT conn_id, -1, 'transcription_delay_ms', '480' FROM messages
    UNION ALL SELECT DISTINCT conn_id, -1, 'temperature', '0.0' FROM messages)
SELECT conn_id, setting, arg_max(value, seq) AS value FROM sent GROUP BY conn_id, setting"""))
def session_settings(spark, root):
    return m.session_settings(buffered_messages(spark, root))


@query("keepalive_counts", with_sql(*BUFFERED, body="""
SELECT conn_id, count(*) FILTER (type = 'session.keepalive') AS keepalive_count,
    count(*) FILTER (type = 'session.keepalive') > 12 AS warning FROM messages GROUP BY conn_id"""))
def keepalive_counts(spark, root):
    return m.keepalive_counts(buffered_messages(spark, root), warn_above=12)


TIMEOUT = 20 * 3600


@query("timeouts", with_sql(*BUFFERED, body=f"""
, m AS (SELECT *, type = 'input_audio_buffer.commit' OR type = 'error' AS turn FROM messages),
g AS (SELECT *, lag(ts) OVER w AS before,
    count(*) FILTER (turn) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS unit,
    last_value(CASE WHEN turn THEN {{'type': type, 'ts': ts}} END IGNORE NULLS)
        OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS state
    FROM m WINDOW w AS (PARTITION BY conn_id ORDER BY seq)),
l AS (SELECT conn_id, unit, min(seq) AS seq, arg_min(before, seq) AS silent, any_value(state.ts) AS committed
    FROM g WHERE state.type <> 'error' AND {SECONDS.format("before", "ts")} > {TIMEOUT} GROUP BY conn_id, unit)
SELECT l.conn_id, l.seq, 'failed' AS status, 'timeout' AS error_type,
    {_r(SECONDS.format('committed', 'silent') + f' + {TIMEOUT}', 2)} AS wait_after_commit,
    (SELECT count(*) FROM g WHERE g.conn_id = l.conn_id AND g.unit = l.unit AND g.seq < l.seq
        AND g.type = 'session.keepalive') AS keepalive_count
FROM l"""))
def timeouts(spark, root):
    return m.timeouts(buffered_messages(spark, root), TIMEOUT)


@query("resolved_texts", with_sql(*ATTEMPTS, body="""
, texts AS (SELECT *, CASE WHEN type = 'partial' THEN CASE k % 3 WHEN 0 THEN concat('p ', k) WHEN 1 THEN concat('q ', k) END END AS heard,
    CASE WHEN type = 'final' THEN CASE k % 4 WHEN 0 THEN concat('f ', k) WHEN 1 THEN concat('a ', k, ' b')
        WHEN 2 THEN concat('s ', k, ' t') END END AS said FROM attempts)
SELECT conn_id, attempt, max(seq) FILTER (type = 'final') AS final_seq,
    coalesce(max(said), arg_max(heard, seq) FILTER (heard IS NOT NULL), '') AS transcript,
    max(said) IS NULL AS from_partial
FROM texts GROUP BY conn_id, attempt HAVING count(*) FILTER (type = 'final') > 0"""))
def resolved_texts(spark, root):
    return m.resolved_texts(dialog_messages(spark, root))


@query("latency_stages", with_sql(*ATTEMPTS, body=f"""
, s AS (SELECT conn_id, attempt AS unit, min(ts) AS t0, min(ts) FILTER (type = 'config') AS tc,
    min(ts) FILTER (type = 'audio') AS ta, max(ts) FILTER (type = 'audio') AS te, max(ts) FILTER (type = 'final') AS tf,
    coalesce(sum(2 * k) FILTER (type = 'audio'), 0)::BIGINT AS bytes_sent,
    count(*) FILTER (type = 'audio') AS chunks_sent FROM attempts GROUP BY conn_id, attempt),
d AS (SELECT *, {SECONDS.format('te', 'tf')} AS wait, {SECONDS.format('t0', 'tf')} AS total,
    bytes_sent / 32000 AS dur FROM s WHERE tf IS NOT NULL)
SELECT conn_id, unit, chunks_sent, bytes_sent, {_r(SECONDS.format('t0', 'tc'), 3)} AS connect_time,
    {_r(SECONDS.format('ta', 'te'), 2)} AS stream_time, {_r('wait', 3)} AS wait_after_commit, {_r('total', 2)} AS total_time,
    CASE WHEN dur > 0 THEN {_r('total / dur', 3)} ELSE 0.0 END AS total_rtf,
    CASE WHEN dur > 0 THEN {_r('wait / dur', 3)} ELSE 0.0 END AS inference_rtf FROM d"""))
def latency_stages(spark, root):
    return m.latency_stages(
        dialog_messages(spark, root), connected=m.CONFIG, streamed=m.AUDIO, committed=m.AUDIO,
        received=m.FINAL, ends=[m.FINAL, m.ERROR, m.CLOSE],
    )


@query("attempt_outcomes", with_sql(*ATTEMPTS, body=f"""
, g AS (SELECT *, {SECONDS.format("lag(ts) OVER w", "ts")} AS wait FROM attempts
    WINDOW w AS (PARTITION BY conn_id, attempt ORDER BY seq)),
c AS (SELECT conn_id, attempt, CASE WHEN max(wait) > {TIMEOUT} THEN 'timeout'
        WHEN bool_or(type = 'error') THEN 'server_error' WHEN NOT bool_or(type = 'final') THEN 'client_error' END AS error_type,
    max(CASE WHEN type = 'error' THEN concat('bad ', k) END) AS error_message FROM g GROUP BY conn_id, attempt)
SELECT conn_id, attempt, CASE WHEN error_type IS NULL THEN 'success' ELSE 'failed' END AS status,
    error_type, error_message FROM c"""))
def attempt_outcomes(spark, root):
    return m.attempt_outcomes(dialog_messages(spark, root), TIMEOUT)


@query("handshake_order", with_sql(*ATTEMPTS, body="""
SELECT conn_id, attempt, coalesce(min(seq) FILTER (type = 'config') < min(seq) FILTER (type = 'audio')
    AND min(seq) FILTER (type = 'audio') < min(seq) FILTER (type = 'final'), FALSE) AS in_order
FROM attempts GROUP BY conn_id, attempt"""))
def handshake_order(spark, root):
    return m.handshake_order(dialog_messages(spark, root), (m.CONFIG, m.AUDIO, m.FINAL))


@query("silent_gaps", with_sql(*BUFFERED, body=f"""
, g AS (SELECT *, CASE WHEN {SECONDS.format("lag(ts) OVER w", "ts")} <= {TIMEOUT} THEN 0 ELSE 1 END AS starts
    FROM messages WINDOW w AS (PARTITION BY conn_id ORDER BY seq)),
s AS (SELECT *, sum(starts) OVER (PARTITION BY conn_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT conn_id, count(*) AS messages, count(*) FILTER (type = 'session.keepalive') AS keepalive_count,
    epoch_us(max(ts)) AS last_us FROM s GROUP BY conn_id, session"""))
def silent_gaps(spark, root):
    sessions = m.activity_sessions(buffered_messages(spark, root), TIMEOUT)
    return sessions.select(
        "conn_id", "messages", "keepalive_count",
        F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("last_message"))
        .alias("last_us"),
    )

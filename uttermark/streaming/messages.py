"""Batch forms of the message operators.

Input: one row per message with (conn_id, seq, ts, type, payload); ``seq`` is a
BIGINT that orders the messages of a connection and is unique within it.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.grading import ratio
from ..functions.text import round_exact
from ..operators.rollup import count_if
from ..operators.scan import BLOCK_ROWS, running, running_breaks

# Message types of the buffered and of the dialog protocol.
APPEND = "input_audio_buffer.append"
FROM_PATH = "input_audio_buffer.from_path"
COMMIT = "input_audio_buffer.commit"
SESSION_UPDATE = "session.update"
KEEPALIVE = "session.keepalive"
DONE = "response.audio_transcript.done"
ERROR = "error"
CONFIG, READY, AUDIO, STOP = "config", "ready", "audio", "stop"
PARTIAL, FINAL, CLOSE = "partial", "final", "close"
BUFFERED_TYPES = (APPEND, FROM_PATH, COMMIT, SESSION_UPDATE, KEEPALIVE, DONE, ERROR)

# Session defaults, warning level, bytes per second of 16 kHz mono PCM.
SESSION_DEFAULTS = {"temperature": "0.0", "transcription_delay_ms": "480"}
KEEPALIVE_WARNING = 50
BYTES_PER_SECOND = 32000

TEXT_PARTS = "text string, lines array<struct<text:string>>, segments array<struct<text:string>>"


def message_type(payload: Column) -> Column:
    """The discriminator is called ``type`` or, for client messages, ``event``."""
    return F.coalesce(F.get_json_object(payload, "$.type"), F.get_json_object(payload, "$.event"))


def chunk_bytes(payload: Column) -> Column:
    """Bytes of audio in a message; a payload that is no base64 holds none."""
    audio = F.get_json_object(payload, "$.audio")
    return F.coalesce(F.octet_length(F.try_to_binary(audio, F.lit("base64"))), F.lit(0)).cast("bigint")


def error_text(payload: Column) -> Column:
    return F.coalesce(
        F.get_json_object(payload, "$.error.message"), F.get_json_object(payload, "$.message"),
        payload,
    )


def message_texts(payload: Column) -> Column:
    """The places of a message that can hold text, parsed once."""
    return F.from_json(payload, TEXT_PARTS)


def spoken_text(body: Column, prefer_lines: bool) -> Column:
    """Text of a partial (lines first) or final (text, lines, segments) message,
    given its message_texts column."""
    lines = F.array_join(
        F.filter(F.transform(body["lines"], lambda x: x["text"]), lambda t: t != ""), " "
    )
    whole = F.nullif(body["text"], F.lit(""))
    joined = F.nullif(lines, F.lit(""))
    if prefer_lines:
        has_lines = F.coalesce(F.size(body["lines"]) > 0, F.lit(False))
        return F.when(has_lines, joined).otherwise(whole)
    segments = F.array_join(
        F.transform(body["segments"], lambda x: F.coalesce(x["text"], F.lit(""))), " "
    )
    return F.coalesce(whole, joined, F.nullif(segments, F.lit("")))


def type_counts(messages: DataFrame, known: Sequence[str] = BUFFERED_TYPES) -> DataFrame:
    """Messages per type; types outside the protocol are kept and marked."""
    kind = F.coalesce(F.col("type"), F.lit(""))
    return (
        messages.groupBy(kind.alias("type"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("known", F.col("type").isin(*known))
    )


def with_unit(
    messages: DataFrame, ends: Sequence[str], name: str = "unit", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Number of ending messages strictly before each message of a connection."""
    is_end = F.col("type").isin(*ends).cast("bigint")
    counted = running(messages, ["conn_id"], "seq", sums={name: is_end}, block_rows=block_rows)
    return counted.withColumn(name, F.col(name) - is_end)


def commit_units(messages: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per commit with what was appended since the previous one.

    A commit on an empty buffer gives a unit of zero bytes; messages after the last
    commit wait for theirs and give nothing.
    """
    kind = F.col("type")
    slim = messages.filter(kind.isin(APPEND, COMMIT, KEEPALIVE)).select(
        "conn_id", "seq", "type",
        F.when(kind == APPEND, chunk_bytes(F.col("payload"))).alias("_bytes"),
    )
    units = with_unit(slim, [COMMIT], block_rows=block_rows)
    return (
        units.groupBy("conn_id", "unit")
        .agg(
            count_if(kind == APPEND).alias("chunks"),
            F.coalesce(F.sum("_bytes"), F.lit(0)).alias("bytes"),
            count_if(kind == KEEPALIVE).alias("keepalives"),
            F.max(F.when(kind == COMMIT, F.col("seq"))).alias("commit_seq"),
        )
        .filter(F.col("commit_seq").isNotNull())
    )


def running_counters(messages: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Chunks and bytes sent so far, at every append of a connection."""
    appended = messages.filter(F.col("type") == APPEND).select(
        "conn_id", "seq", chunk_bytes(F.col("payload")).alias("chunk_bytes")
    )
    return running(
        appended, ["conn_id"], "seq",
        sums={"chunks_sent": F.lit(1).cast("bigint"), "bytes_sent": F.col("chunk_bytes")},
        block_rows=block_rows,
    )


def session_settings(messages: DataFrame) -> DataFrame:
    """Last value per connection and setting, over the session defaults."""
    sent = messages.filter(F.col("type") == SESSION_UPDATE).select(
        "conn_id", "seq",
        F.explode(
            F.from_json(F.get_json_object("payload", "$.session"), "map<string,string>")
        ).alias("setting", "value"),
    )
    defaults = F.create_map(*[F.lit(x) for pair in SESSION_DEFAULTS.items() for x in pair])
    base = messages.select("conn_id").distinct().select(
        "conn_id", F.lit(-1).cast("bigint").alias("seq"), F.explode(defaults).alias("setting", "value")
    )
    return sent.unionByName(base).groupBy("conn_id", "setting").agg(
        F.max_by("value", "seq").alias("value")
    )


def keepalive_counts(messages: DataFrame, warn_above: int = KEEPALIVE_WARNING) -> DataFrame:
    return (
        messages.groupBy("conn_id")
        .agg(count_if(F.col("type") == KEEPALIVE).alias("keepalive_count"))
        .withColumn("warning", F.col("keepalive_count") > warn_above)
    )


def seconds_between(earlier: Column, later: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later) / 1e6


def timeouts(
    messages: DataFrame,
    limit_seconds: float,
    until: datetime | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One failed row for every commit whose result did not come because nothing came for
    longer than the limit, whatever arrived later.

    ``seq`` is the message that ended the silence. The wait runs from the commit to the
    moment the limit was reached, and only keep-alives since the commit count. With
    ``until``, connections that are silent up to that time fail too, with the number after
    their last message.
    """
    slim = messages.select("conn_id", "seq", "ts", "type")
    if until is not None:
        ends = slim.groupBy("conn_id").agg((F.max("seq") + 1).alias("seq"))
        slim = slim.unionByName(
            ends.select(
                "conn_id", "seq", F.lit(until).cast(slim.schema["ts"].dataType).alias("ts"),
                F.lit("").alias("type"),
            )
        )
    turns = F.col("type").isin(COMMIT, DONE, ERROR)
    turn, alive = turns.cast("bigint"), (F.col("type") == KEEPALIVE).cast("bigint")
    scanned = running(
        slim, ["conn_id"], "seq",
        sums={"_turn": turn, "_alive": alive},
        lasts={
            "_previous": F.col("ts"),
            "_state": F.when(turns, F.struct("type", "ts")),
        },
        block_rows=block_rows,
    ).filter(F.col("_state.type") == COMMIT)
    late = F.when(
        seconds_between(F.col("_previous"), F.col("ts")) > limit_seconds, F.col("seq")
    )
    before = F.col("_alive") - alive
    waits = scanned.groupBy("conn_id", (F.col("_turn") - turn).alias("_unit")).agg(
        F.min(late).alias("seq"),
        F.min_by("_previous", late).alias("_silent"),
        F.min("_state.ts").alias("_committed"),
        (F.min_by(before, late) - F.min(before)).alias("keepalive_count"),
    )
    wait = seconds_between(F.col("_committed"), F.col("_silent")) + limit_seconds
    return waits.filter("seq IS NOT NULL").select(
        "conn_id", "seq",
        F.lit("failed").alias("status"),
        F.lit("timeout").alias("error_type"),
        round_exact(wait, 2).alias("wait_after_commit"),
        "keepalive_count",
    )


def activity_sessions(
    messages: DataFrame, limit_seconds: float, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Stretches of a connection without a wait above the limit."""

    def late(before: Column, now: Column) -> Column:
        return F.coalesce(seconds_between(before, now) > limit_seconds, F.lit(True))

    numbered = running_breaks(
        messages.select("conn_id", "seq", "ts", "type"), ["conn_id"], "seq", "ts", late, "session", block_rows
    )
    return numbered.groupBy("conn_id", "session").agg(
        F.count(F.lit(1)).alias("messages"),
        count_if(F.col("type") == KEEPALIVE).alias("keepalive_count"),
        F.max("ts").alias("last_message"),
    )


def dialog_attempts(messages: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Number the attempts of a connection; final, error and close end one."""
    return with_unit(messages, [FINAL, ERROR, CLOSE], "attempt", block_rows)


def resolved_texts(messages: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Transcript of every finished attempt: final text, its lines, its segments, or
    the last non-empty partial before it."""
    kind = F.col("type")
    parsed = messages.filter(kind.isin(PARTIAL, FINAL, ERROR, CLOSE)).select(
        "conn_id", "seq", "type", message_texts(F.col("payload")).alias("_body")
    )
    said = parsed.select(
        "conn_id", "seq", "type",
        F.when(kind == PARTIAL, spoken_text(F.col("_body"), True)).alias("_partial"),
        F.when(kind == FINAL, spoken_text(F.col("_body"), False)).alias("_final"),
    )
    is_end = kind.isin(FINAL, ERROR, CLOSE)
    ended = is_end.cast("bigint")
    rows = running(
        said, ["conn_id"], "seq",
        sums={"_ended": ended},
        lasts={
            "_last": F.when(
                F.col("_partial").isNotNull(), F.struct("seq", F.col("_partial").alias("text"))
            ),
            "_end": F.when(is_end, F.col("seq")),
        },
        block_rows=block_rows,
    ).withColumn("attempt", F.col("_ended") - ended)
    same_attempt = F.col("_end").isNull() | (F.col("_last.seq") > F.col("_end"))
    own_partial = F.when(same_attempt, F.col("_last.text"))
    return rows.filter(kind == FINAL).select(
        "conn_id", "attempt", F.col("seq").alias("final_seq"),
        F.coalesce(F.col("_final"), own_partial, F.lit("")).alias("transcript"),
        F.col("_final").isNull().alias("from_partial"),
    )


def stage_columns() -> list[Column]:
    """Seconds and real-time factors of a unit out of the times of its stages."""
    wait = seconds_between(F.col("_committed"), F.col("_received"))
    total = seconds_between(F.col("_start"), F.col("_received"))
    duration = F.col("bytes_sent") / BYTES_PER_SECOND
    return [
        round_exact(seconds_between(F.col("_start"), F.col("_connected")), 3).alias("connect_time"),
        round_exact(seconds_between(F.col("_stream"), F.col("_committed")), 2).alias("stream_time"),
        round_exact(wait, 3).alias("wait_after_commit"),
        round_exact(total, 2).alias("total_time"),
        ratio(total, duration).alias("total_rtf"),
        ratio(wait, duration).alias("inference_rtf"),
    ]


def latency_stages(
    messages: DataFrame, *, connected: str, streamed: str, committed: str, received: str,
    ends: Sequence[str], block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Connect, stream, wait and total seconds of every unit that got its result,
    with the real-time factors over the seconds of audio sent."""
    kind = F.col("type")
    slim = messages.select(
        "conn_id", "seq", "ts", "type",
        F.when(kind == streamed, chunk_bytes(F.col("payload"))).alias("_bytes"),
    )
    units = with_unit(slim, ends, block_rows=block_rows)

    def first(of: str) -> Column:
        return F.min(F.when(kind == of, F.col("ts")))

    stages = units.groupBy("conn_id", "unit").agg(
        F.min("ts").alias("_start"),
        first(connected).alias("_connected"),
        first(streamed).alias("_stream"),
        F.max(F.when(kind == committed, F.col("ts"))).alias("_committed"),
        F.max(F.when(kind == received, F.col("ts"))).alias("_received"),
        F.coalesce(F.sum("_bytes"), F.lit(0)).alias("bytes_sent"),
        count_if(kind == streamed).alias("chunks_sent"),
    )
    return stages.filter(F.col("_received").isNotNull()).select(
        "conn_id", "unit", "chunks_sent", "bytes_sent", *stage_columns()
    )


def attempt_outcomes(
    messages: DataFrame, limit_seconds: float, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Status and error type of every attempt.

    A wait above the limit is a time-out whatever came later; an attempt without
    any ending message failed on the client.
    """
    kind = F.col("type")
    is_end = kind.isin(FINAL, ERROR, CLOSE)
    ended_now = is_end.cast("bigint")
    rows = running(
        messages, ["conn_id"], "seq",
        sums={"_ended": ended_now},
        lasts={"_previous": F.struct(F.col("ts"), is_end.alias("ended"))},
        block_rows=block_rows,
    ).withColumn("attempt", F.col("_ended") - ended_now)
    wait = F.when(
        ~F.col("_previous.ended"), seconds_between(F.col("_previous.ts"), F.col("ts"))
    )
    ended = F.max(F.when(kind.isin(FINAL, ERROR, CLOSE), kind))
    error_type = (
        F.when(F.max(wait) > limit_seconds, "timeout")
        .when(ended == ERROR, "server_error")
        .when(ended == CLOSE, "websocket_closed")
        .when(ended.isNull(), "client_error")
    )
    return rows.groupBy("conn_id", "attempt").agg(
        F.when(error_type.isNull(), "success").otherwise("failed").alias("status"),
        error_type.alias("error_type"),
        F.max(F.when(kind == ERROR, error_text(F.col("payload")))).alias("error_message"),
    )


def handshake_order(
    messages: DataFrame,
    expected: Sequence[str] = (CONFIG, READY, AUDIO, STOP, FINAL),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Does every attempt see the expected types, each first met in that order?

    The first positions are compared, so no message list of a connection is built.
    """
    rows = dialog_attempts(messages.select("conn_id", "seq", "type"), block_rows)
    firsts = rows.groupBy("conn_id", "attempt").agg(
        *[
            F.min(F.when(F.col("type") == t, F.col("seq"))).alias(f"_{i}")
            for i, t in enumerate(expected)
        ]
    )
    in_order = F.lit(True)
    for i in range(1, len(expected)):
        in_order = in_order & F.coalesce(F.col(f"_{i - 1}") < F.col(f"_{i}"), F.lit(False))
    return firsts.select("conn_id", "attempt", in_order.alias("in_order"))

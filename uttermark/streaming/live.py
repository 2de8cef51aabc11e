"""Structured Streaming forms of the message operators.

Messages of a connection are folded in the order of ``seq``, one by one, by processors of
``transformWithState``. A message that arrives waits in a reorder buffer until the
watermark has passed its time, so messages that come in a later micro-batch than their
successors take their place, as long as they are no later than the watermark allows; Spark
drops what is later still. ``ts`` must not fall while ``seq`` rises. The buffer holds the
messages of one connection within the watermark's delay.

Event-time timers do what no message does: they release the buffer, end a wait that is too
long, and after ``ttl`` without a message end the connection and drop its state. A
connection that speaks again after that begins anew, with numbers from 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.grading import is_success
from ..functions.text import round_exact
from ..operators.rollup import count_if
from .messages import (
    APPEND, AUDIO, CLOSE, COMMIT, CONFIG, DONE, ERROR, FINAL, KEEPALIVE, PARTIAL, READY,
    SESSION_DEFAULTS, SESSION_UPDATE, STOP, chunk_bytes, error_text, message_texts,
    spoken_text, stage_columns,
)

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TTL = "1 day"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep operator state in RocksDB, which the stateful operators below need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _micros(duration: str) -> int:
    return int(pd.Timedelta(duration).total_seconds() * 1_000_000)


class _Connection(StatefulProcessor):
    """Fold the messages of one connection in their order.

    A subclass names the columns of a message behind ``seq`` and ``us``, the fields of its
    state and those of its result, and says what a message does to the state (``step``),
    until when it waits for one (``deadline``), what a wait beyond that does (``expire``)
    and what is left to say once the connection is over (``end``). Each gives result rows.
    """

    MESSAGE = "type string"
    STATE = ""
    RESULT = ""

    def __init__(self, ttl: str) -> None:
        self._ttl = _micros(ttl)
        names = lambda ddl: [part.split()[0] for part in ddl.split(", ") if part]
        self._columns = ["seq", "us", *names(self.MESSAGE)]
        self._fields = ["last_seq", "last_us", "timer", *names(self.STATE)]
        self._result = ["conn_id", *names(self.RESULT)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        state = f"last_seq bigint, last_us bigint, timer bigint, {self.STATE}"
        self._state = handle.getValueState("state", state)
        self._waiting = handle.getListState("waiting", f"seq bigint, us bigint, {self.MESSAGE}")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any):
        for chunk in rows:
            found = chunk[self._columns].astype(object)
            found = found.where(found.notna(), None)
            self._waiting.appendList(list(found.itertuples(index=False, name=None)))
        yield from self._advance(key, timerValues)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any):
        yield from self._advance(key, timerValues)

    def _advance(self, key: Any, timerValues: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = list(self._waiting.get()) if self._waiting.exists() else []
        due = sorted((tuple(m) for m in waiting if m[1] <= now), key=lambda m: m[0])
        later = [tuple(m) for m in waiting if m[1] > now]
        if self._state.exists():
            state = dict(zip(self._fields, self._state.get()))
        else:
            state = dict.fromkeys(self._fields) | self.begin()
        out = []
        for message in due:
            row = dict(zip(self._columns, message))
            if state["last_seq"] is not None and row["seq"] <= state["last_seq"]:
                continue  # delivered twice
            out += self._expired(state, row["us"])
            if state["last_us"] is not None and row["us"] - state["last_us"] > self._ttl:
                out += self.end(state)
                state |= dict.fromkeys(self._fields[3:]) | self.begin()
            out += self.step(state, row)
            state["last_seq"], state["last_us"] = row["seq"], row["us"]
        out += self._expired(state, now)
        if due and later:
            self._waiting.put(later)
        elif due:
            self._waiting.clear()
        if state["timer"] is not None:
            self._handle.deleteTimer(state["timer"])
        over = state["last_us"] is not None and now - state["last_us"] > self._ttl
        if over:
            out += self.end(state)
            self._state.clear()
            state = dict.fromkeys(self._fields) | self.begin()
        times = [min(m[1] for m in later)] if later else []
        if state["last_us"] is not None:
            times += [t for t in (self.deadline(state), state["last_us"] + self._ttl) if t is not None]
        if times:
            state["timer"] = min(times) // 1000 + 1
            self._handle.registerTimer(state["timer"])
            self._state.update(tuple(state[f] for f in self._fields))
        if out:
            yield pd.DataFrame([(key[0], *row) for row in out], columns=self._result, dtype=object)

    def _expired(self, state: dict, us: int) -> list[tuple]:
        """What a silence from the last message to ``us`` gives."""
        limit = self.deadline(state) if state["last_us"] is not None else None
        return self.expire(state) if limit is not None and us > limit else []

    def begin(self) -> dict:
        return {}

    def step(self, state: dict, row: dict) -> list[tuple]:
        raise NotImplementedError

    def deadline(self, state: dict) -> int | None:
        return None

    def expire(self, state: dict) -> list[tuple]:
        return []

    def end(self, state: dict) -> list[tuple]:
        return []

    def close(self) -> None:
        pass


class _CommitUnits(_Connection):
    MESSAGE = "type string, chunk_bytes bigint"
    STATE = "unit bigint, chunks bigint, bytes bigint"
    RESULT = "unit bigint, chunks bigint, bytes bigint, commit_seq bigint"

    def begin(self):
        return {"unit": 0, "chunks": 0, "bytes": 0}

    def step(self, state, row):
        if row["type"] == APPEND:
            state["chunks"] += 1
            state["bytes"] += row["chunk_bytes"]
            return []
        done = (state["unit"], state["chunks"], state["bytes"], row["seq"])
        state |= {"unit": state["unit"] + 1, "chunks": 0, "bytes": 0}
        return [done]


class _ResolvedTexts(_Connection):
    MESSAGE = "type string, text string"
    STATE = "attempt bigint, partial string"
    RESULT = "attempt bigint, final_seq bigint, transcript string, from_partial boolean"

    def begin(self):
        return {"attempt": 0}

    def step(self, state, row):
        if row["type"] == PARTIAL:
            state["partial"] = state["partial"] if row["text"] is None else row["text"]
            return []
        own, heard, attempt = row["text"], state["partial"], state["attempt"]
        state |= {"attempt": attempt + 1, "partial": None}
        if row["type"] != FINAL:
            return []
        text = own if own is not None else heard if heard is not None else ""
        return [(attempt, row["seq"], text, own is None)]


class _Timeouts(_Connection):
    """The open commit, if the last turn was one: its time, keep-alives since, and
    whether it has failed already."""

    STATE = "committed bigint, alive bigint, failed boolean"
    RESULT = "last_seq bigint, wait_us bigint, keepalive_count bigint"

    def __init__(self, ttl: str, limit_us: int) -> None:
        super().__init__(ttl)
        self._limit = limit_us

    def step(self, state, row):
        if row["type"] in (COMMIT, DONE, ERROR):
            opens = row["us"] if row["type"] == COMMIT else None
            state |= {"committed": opens, "alive": 0, "failed": False}
        elif row["type"] == KEEPALIVE and state["committed"] is not None:
            state["alive"] += 1
        return []

    def deadline(self, state):
        open_ = state["committed"] is not None and not state["failed"]
        return state["last_us"] + self._limit if open_ else None

    def expire(self, state):
        state["failed"] = True
        wait = state["last_us"] - state["committed"] + self._limit
        return [(state["last_seq"], wait, state["alive"])]


class _LatencyStages(_Connection):
    """Times and sizes of the open unit."""

    MESSAGE = "type string, chunk_bytes bigint"
    STATE = (
        "unit bigint, start bigint, connected bigint, stream bigint, committed bigint, "
        "received bigint, chunks bigint, bytes bigint"
    )
    RESULT = STATE

    def __init__(
        self, ttl: str, connected: str, streamed: str, committed: str, received: str, ends: Sequence[str]
    ) -> None:
        super().__init__(ttl)
        self._kinds = (connected, streamed, committed, received)
        self._ends = tuple(ends)

    def begin(self):
        return {"unit": 0, "chunks": 0, "bytes": 0}

    def step(self, state, row):
        connected, streamed, committed, received = self._kinds
        kind, us = row["type"], row["us"]
        first = lambda name: us if state[name] is None else state[name]
        state["start"] = first("start")
        if kind == connected:
            state["connected"] = first("connected")
        if kind == streamed:
            state |= {"stream": first("stream"), "chunks": state["chunks"] + 1}
            state["bytes"] += row["chunk_bytes"]
        if kind == committed:
            state["committed"] = us
        if kind == received:
            state["received"] = us
        if kind not in self._ends:
            return []
        names = self._fields[3:]
        done = tuple(state[n] for n in names)
        state |= dict.fromkeys(names) | {"unit": state["unit"] + 1, "chunks": 0, "bytes": 0}
        return [done] if done[names.index("received")] is not None else []


class _AttemptOutcomes(_Connection):
    """Start, longest wait, error text and first positions of the expected types of the
    open attempt."""

    MESSAGE = "type string, error_text string"
    RESULT = (
        "attempt bigint, ended string, late boolean, error_message string, in_order boolean, "
        "started bigint, received bigint"
    )

    def __init__(self, ttl: str, limit_us: int, expected: Sequence[str]) -> None:
        self._firsts = [f"first_{i}" for i in range(len(expected))]
        self.STATE = "attempt bigint, started bigint, late boolean, error string, " + ", ".join(
            f"{name} bigint" for name in self._firsts
        )
        super().__init__(ttl)
        self._limit, self._expected = limit_us, tuple(expected)

    def begin(self):
        return {"attempt": 0, "late": False}

    def step(self, state, row):
        kind, us = row["type"], row["us"]
        if state["started"] is None:
            state["started"] = us
        elif us - state["last_us"] > self._limit:
            state["late"] = True
        for name, expected in zip(self._firsts, self._expected):
            if kind == expected and state[name] is None:
                state[name] = row["seq"]
        if kind == ERROR:
            state["error"] = row["error_text"]
        if kind not in (FINAL, ERROR, CLOSE):
            return []
        return [self._outcome(state, kind, us)]

    def _outcome(self, state, ended, received):
        seen = [state[name] for name in self._firsts]
        in_order = all(
            a is not None and b is not None and a < b for a, b in zip(seen, seen[1:])
        )
        done = (
            state["attempt"], ended, state["late"], state["error"], in_order, state["started"], received
        )
        blank = dict.fromkeys(["started", "error", *self._firsts])
        state |= blank | {"attempt": state["attempt"] + 1, "late": False}
        return done

    def end(self, state):
        return [self._outcome(state, None, None)] if state["started"] is not None else []


def _folded(slim: DataFrame, processor: _Connection) -> DataFrame:
    """Result rows of the processor; ``slim`` has conn_id, seq, ts and its columns."""
    rows = slim.withColumn("us", F.unix_micros("ts"))
    return rows.groupBy("conn_id").transformWithStateInPandas(
        processor, outputStructType=f"conn_id bigint, {processor.RESULT}",
        outputMode="Append", timeMode="EventTime",
    )


def stream_commit_units(messages: DataFrame, watermark: str = "1 hour", ttl: str = TTL) -> DataFrame:
    """Streaming form of commit_units; a unit leaves with its commit."""
    slim = (
        messages.withWatermark("ts", watermark)
        .filter(F.col("type").isin(APPEND, COMMIT))
        .select(
            "conn_id", "seq", "ts", "type",
            F.when(F.col("type") == APPEND, chunk_bytes(F.col("payload")))
            .otherwise(F.lit(0)).alias("chunk_bytes"),
        )
    )
    return _folded(slim, _CommitUnits(ttl))


def stream_resolved_texts(messages: DataFrame, watermark: str = "1 hour", ttl: str = TTL) -> DataFrame:
    """Streaming form of resolved_texts; a transcript leaves with its final message."""
    kind = F.col("type")
    slim = (
        messages.withWatermark("ts", watermark)
        .filter(kind.isin(PARTIAL, FINAL, ERROR, CLOSE))
        .select("conn_id", "seq", "ts", "type", message_texts(F.col("payload")).alias("body"))
        .select(
            "conn_id", "seq", "ts", "type",
            F.when(kind == PARTIAL, spoken_text(F.col("body"), True))
            .when(kind == FINAL, spoken_text(F.col("body"), False)).alias("text"),
        )
    )
    return _folded(slim, _ResolvedTexts(ttl))


def stream_timeouts(
    messages: DataFrame, limit_seconds: float, watermark: str = "1 hour", ttl: str = TTL
) -> DataFrame:
    """Streaming form of timeouts: a failed row for each commit without a result because
    nothing came for longer than the limit, be it that the connection stays silent for
    good. The row leaves once the watermark passes the limit, with no message of its own;
    ``last_seq`` is the message before the silence."""
    slim = messages.withWatermark("ts", watermark).select("conn_id", "seq", "ts", "type")
    found = _folded(slim, _Timeouts(ttl, int(limit_seconds * 1e6)))
    return found.select(
        "conn_id", "last_seq",
        F.lit("failed").alias("status"),
        F.lit("timeout").alias("error_type"),
        round_exact(F.col("wait_us") / 1e6, 2).alias("wait_after_commit"),
        "keepalive_count",
    )


def stream_latency_stages(
    messages: DataFrame, *, connected: str, streamed: str, committed: str, received: str,
    ends: Sequence[str], watermark: str = "1 hour", ttl: str = TTL,
) -> DataFrame:
    """Streaming form of latency_stages, all of its columns; the stages of a unit wait in
    state and leave with the message that ends it, of which a result must be one kind."""
    if received not in ends:
        raise ValueError("a result must end its unit")
    kind = F.col("type")
    slim = messages.withWatermark("ts", watermark).select(
        "conn_id", "seq", "ts", "type",
        F.when(kind == streamed, chunk_bytes(F.col("payload"))).otherwise(F.lit(0)).alias("chunk_bytes"),
    )
    found = _folded(slim, _LatencyStages(ttl, connected, streamed, committed, received, ends))
    times = ("start", "connected", "stream", "committed", "received")
    return found.select(
        "conn_id", "unit", F.col("chunks").alias("chunks_sent"), F.col("bytes").alias("bytes_sent"),
        *[F.timestamp_micros(t).alias(f"_{t}") for t in times],
    ).select("conn_id", "unit", "chunks_sent", "bytes_sent", *stage_columns())


def stream_attempt_outcomes(
    messages: DataFrame,
    limit_seconds: float,
    expected: Sequence[str] = (CONFIG, READY, AUDIO, STOP, FINAL),
    watermark: str = "1 hour",
    ttl: str = TTL,
) -> DataFrame:
    """Streaming form of attempt_outcomes and handshake_order, with the total time; a row
    leaves with the ending message of its attempt. An attempt still open after ``ttl``
    without a message failed on the client, or timed out if a wait was too long."""
    slim = messages.withWatermark("ts", watermark).select(
        "conn_id", "seq", "ts", "type",
        F.when(F.col("type") == ERROR, error_text(F.col("payload"))).alias("error_text"),
    )
    found = _folded(slim, _AttemptOutcomes(ttl, int(limit_seconds * 1e6), expected))
    error = (
        F.when(F.col("late"), "timeout")
        .when(F.col("ended") == ERROR, "server_error")
        .when(F.col("ended") == CLOSE, "websocket_closed")
        .when(F.col("ended").isNull(), "client_error")
    )
    return found.select(
        "conn_id", "attempt",
        F.when(error.isNull(), "success").otherwise("failed").alias("status"),
        error.alias("error_type"), "error_message", "in_order",
        round_exact((F.col("received") - F.col("started")) / 1e6, 2).alias("total_time"),
    )


def stream_keepalives(
    messages: DataFrame, window: str = "1 hour", watermark: str = "1 hour"
) -> DataFrame:
    """Keep-alives per connection and time window."""
    return (
        messages.withWatermark("ts", watermark)
        .groupBy(F.window("ts", window), "conn_id")
        .agg(count_if(F.col("type") == KEEPALIVE).alias("keepalive_count"))
    )


def stream_silences(messages: DataFrame, gap: str, watermark: str = "1 hour") -> DataFrame:
    """Activity sessions per connection; a session ends where no message came for
    the gap, which is the response time-out."""
    return (
        messages.withWatermark("ts", watermark)
        .groupBy("conn_id", F.session_window("ts", gap))
        .agg(
            F.count(F.lit(1)).alias("messages"),
            count_if(F.col("type") == KEEPALIVE).alias("keepalive_count"),
            F.max("ts").alias("last_message"),
        )
        .drop("session_window")
    )


def stream_settings(messages: DataFrame) -> DataFrame:
    """Last value per connection and setting over the session defaults, for update or
    complete output. State is one value per setting of each connection."""
    entry = "array<struct<setting:string,value:string,seq:bigint>>"
    defaults = F.array(
        *[
            F.struct(F.lit(k).alias("setting"), F.lit(v).alias("value"), F.lit(-1).alias("seq"))
            for k, v in SESSION_DEFAULTS.items()
        ]
    )
    given = F.from_json(F.get_json_object("payload", "$.session"), "map<string,string>")
    sent = F.transform(
        F.map_entries(given),
        lambda e: F.struct(e["key"].alias("setting"), e["value"].alias("value"), F.col("seq").alias("seq")),
    )
    update = F.when(F.col("type") == SESSION_UPDATE, sent.cast(entry))
    every = F.concat(defaults.cast(entry), F.coalesce(update, F.array().cast(entry)))
    rows = messages.select("conn_id", F.inline(every))
    return rows.groupBy("conn_id", "setting").agg(F.max_by("value", "seq").alias("value"))


def resume_sink(path: str, keys: Sequence[str] = ("file",)) -> Callable[[DataFrame, int], None]:
    """foreachBatch function that appends results whose key has no success in
    ``path`` yet. Each batch writes its own directory, so a repeated batch replaces
    its earlier attempt instead of adding rows twice."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        target = f"{path}/batch_id={batch_id}"
        try:
            earlier = spark.read.parquet(path).filter(F.col("batch_id") < batch_id)
        except Exception as missing:  # nothing written so far
            if "PATH_NOT_FOUND" not in str(missing) and "INFER_SCHEMA" not in str(missing):
                raise
            new = batch
        else:
            done = earlier.filter(is_success(F.col("status"))).select(*keys).distinct()
            new = batch.join(done, list(keys), "left_anti")
        new.write.mode("overwrite").parquet(target)

    return write

import base64
import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from uttermark.streaming import live, messages as m

START = dt.datetime(2026, 4, 19, 8, 0, 0)
SCHEMA = "conn_id long, seq long, ts timestamp, type string, payload string"


def make(spark, rows):
    """rows: (conn, seconds, type, body)"""
    data = [
        (c, i, START + dt.timedelta(seconds=s), t, json.dumps({"type": t, **body}))
        for i, (c, s, t, body) in enumerate(rows)
    ]
    return spark.createDataFrame(data, SCHEMA)


def audio(n):
    return {"audio": base64.b64encode(b"x" * n).decode()}


def collected(df):
    return sorted(tuple(r) for r in df.collect())


def test_commits(spark):
    rows = [
        (1, 0, m.COMMIT, {}), (1, 1, m.APPEND, audio(4)), (1, 2, m.KEEPALIVE, {}), (1, 3, m.APPEND, audio(6)),
        (1, 4, m.APPEND, {}), (1, 5, m.COMMIT, {}), (1, 6, m.APPEND, audio(9)), (2, 7, m.APPEND, audio(3)),
    ]
    for block in (2, m.BLOCK_ROWS):
        got = m.commit_units(make(spark, rows), block_rows=block)
        assert collected(got.select("conn_id", "unit", "chunks", "bytes", "keepalives", "commit_seq")) == [
            (1, 0, 0, 0, 0, 0), (1, 1, 3, 10, 1, 5),
        ]


def test_settings_keep_the_last_value(spark):
    rows = [
        (1, 0, m.SESSION_UPDATE, {"session": {"transcription_delay_ms": 240, "modalities": ["text"]}}),
        (1, 1, m.SESSION_UPDATE, {"session": {"transcription_delay_ms": 1200}}), (2, 2, m.APPEND, audio(1)),
    ]
    assert collected(m.session_settings(make(spark, rows))) == [
        (1, "modalities", '["text"]'), (1, "temperature", "0.0"), (1, "transcription_delay_ms", "1200"),
        (2, "temperature", "0.0"), (2, "transcription_delay_ms", "480"),
    ]


def test_keepalives_warn_above_fifty(spark):
    rows = [(1, i, m.KEEPALIVE, {}) for i in range(50)] + [(2, i, m.KEEPALIVE, {}) for i in range(51)]
    assert collected(m.keepalive_counts(make(spark, rows))) == [(1, 50, False), (2, 51, True)]


def test_text_resolution(spark):
    rows = [
        (1, 0, m.PARTIAL, {"text": "p1"}), (1, 1, m.PARTIAL, {"text": ""}), (1, 2, m.FINAL, {"text": ""}),
        (1, 3, m.FINAL, {"text": ""}),
        (2, 0, m.PARTIAL, {"lines": [{"text": "a"}, {"text": ""}, {"x": 1}, {"text": "b"}], "text": "no"}),
        (2, 1, m.FINAL, {}), (2, 2, m.PARTIAL, {"text": "lost"}), (2, 3, m.ERROR, {"message": "m"}),
        (2, 4, m.FINAL, {"text": "", "lines": [{"text": "l"}, {"text": "m"}]}),
        (3, 0, m.FINAL, {"segments": [{"text": "s"}, {}, {"text": "t"}]}),
        (3, 1, m.FINAL, {"text": "f", "lines": [{"text": "l"}]}), (3, 2, m.PARTIAL, {"text": "open"}),
    ]
    want = [
        (1, 0, 2, "p1", True), (1, 1, 3, "", True), (2, 0, 5, "a b", True), (2, 2, 8, "l m", False),
        (3, 0, 9, "s  t", False), (3, 1, 10, "f", False),
    ]
    for block in (3, m.BLOCK_ROWS):
        assert collected(m.resolved_texts(make(spark, rows), block_rows=block)) == want


def test_timeouts_and_outcomes(spark):
    rows = [
        (1, 0, m.AUDIO, {}), (1, 5, m.KEEPALIVE, {}), (1, 66, m.FINAL, {"text": "x"}), (1, 500, m.AUDIO, {}),
        (1, 501, m.ERROR, {"error": {"message": "boom"}}), (1, 502, m.CLOSE, {}), (1, 503, m.AUDIO, {}),
        (2, 0, m.FINAL, {"text": "x"}),
    ]
    waits = [
        (1, 0, m.KEEPALIVE, {}), (1, 1, m.COMMIT, {}), (1, 5, m.KEEPALIVE, {}), (1, 9, m.KEEPALIVE, {}),
        (1, 70, m.KEEPALIVE, {}), (1, 71, m.DONE, {}), (1, 200, m.COMMIT, {}), (1, 250, m.DONE, {}),
        (1, 400, m.APPEND, {}), (2, 10, m.COMMIT, {}), (2, 20, m.KEEPALIVE, {}), (3, 10, m.KEEPALIVE, {}),
    ]
    columns = ("conn_id", "seq", "wait_after_commit", "keepalive_count")
    for block in (2, m.BLOCK_ROWS):
        got = m.timeouts(make(spark, waits), 60, block_rows=block)
        assert collected(got.select(*columns)) == [(1, 4, 68.0, 2)]
        last = make(spark, waits).agg(F.max("ts")).first()[0]
        got = m.timeouts(make(spark, waits), 60, until=last, block_rows=block)
        ends = {r[0]: r[2:] for r in collected(got.select(*columns)) if r[0] == 2}
        assert ends == {2: (70.0, 1)}
        outcome = m.attempt_outcomes(make(spark, rows), 60, block_rows=block)
        assert collected(outcome.select("conn_id", "attempt", F.coalesce("error_type", F.lit("-")),
                                        F.coalesce("error_message", F.lit("-")))) == [
            (1, 0, "timeout", "-"), (1, 1, "server_error", "boom"), (1, 2, "websocket_closed", "-"),
            (1, 3, "client_error", "-"), (2, 0, "-", "-"),
        ]


def test_latency(spark):
    rows = [
        (1, 0, m.CONFIG, {}), (1, 1, m.READY, {}), (1, 2, m.AUDIO, audio(64000)), (1, 4, m.STOP, {}),
        (1, 7, m.FINAL, {"text": "x"}), (1, 8, m.CONFIG, {}),
    ]
    got = m.latency_stages(make(spark, rows), connected=m.READY, streamed=m.AUDIO, committed=m.STOP,
                           received=m.FINAL, ends=[m.FINAL]).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["connect_time"], r["stream_time"], r["wait_after_commit"], r["total_time"]) == (1.0, 2.0, 3.0, 7.0)
    assert (r["total_rtf"], r["inference_rtf"], r["chunks_sent"]) == (3.5, 1.5, 1)


def test_handshake(spark):
    good = [m.CONFIG, m.READY, m.AUDIO, m.AUDIO, m.PARTIAL, m.STOP, m.FINAL]
    bad = [m.CONFIG, m.AUDIO, m.READY, m.STOP, m.FINAL]
    rows = [(1, i, t, {}) for i, t in enumerate(good)] + [(1, 9 + i, t, {}) for i, t in enumerate(bad)]
    rows += [(2, 0, m.CONFIG, {})]
    assert collected(m.handshake_order(make(spark, rows))) == [(1, 0, True), (1, 1, False), (2, 0, False)]


def test_discriminator(spark):
    df = spark.createDataFrame([('{"type":"a"}',), ('{"event":"stop"}',), ("{}",)], "p string")
    assert [r[0] for r in df.select(m.message_type(F.col("p"))).collect()] == ["a", "stop", None]
    rows = [(1, 0, m.APPEND, {}), (1, 1, "odd", {}), (1, 2, "odd", {})]
    assert collected(m.type_counts(make(spark, rows))) == [(m.APPEND, 1, True), ("odd", 2, False)]


# ------------------------------------------------------------------ streaming


def write_batches(spark, folder, batches):
    """One file for each micro-batch; the last one holds messages of another connection
    ten days on, so that the watermark passes all others."""
    late = [
        (99, 10**6 + i, START + dt.timedelta(days=10), kind, "{}") for i, kind in enumerate((m.COMMIT, m.CLOSE))
    ]
    for rows in [*batches, late]:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / "in"))


@pytest.fixture(scope="module")
def stream_files(spark, tmp_path_factory):
    """Random traffic of a hot and some quiet connections, in several files; every eighth
    message arrives a file later than its successors."""
    rng = random.Random(11)
    kinds = [m.APPEND, m.COMMIT, m.KEEPALIVE, m.PARTIAL, m.PARTIAL, m.FINAL, m.ERROR, m.SESSION_UPDATE]
    rows = []
    for i in range(600):
        conn = 0 if rng.random() < 0.4 else rng.randrange(1, 9)
        kind = rng.choice(kinds)
        body = {
            m.APPEND: lambda: audio(rng.randrange(9)),
            m.PARTIAL: lambda: {"text": rng.choice(["", f"p{i}"])},
            m.FINAL: lambda: {"text": rng.choice(["", f"f{i}"])},
            m.SESSION_UPDATE: lambda: {"session": {"delay": i, rng.choice("ab"): i}},
        }.get(kind, dict)()
        rows.append((conn, i * 10, kind, body))
    df = make(spark, rows)
    parts = sorted((tuple(r) for r in df.collect()), key=lambda r: r[1])
    batches = [[] for _ in range(7)]
    for i, row in enumerate(parts):
        batches[i // 100 + (i % 8 == 0)].append(row)
    folder = tmp_path_factory.mktemp("stream")
    write_batches(spark, folder, batches)
    return df, folder


def run_stream(spark, folder, build, name, mode="append", progress=None):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    query = (
        build(source).writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(folder / f"cp_{name}")).trigger(availableNow=True).start()
    )
    query.awaitTermination(180)
    assert query.exception() is None
    if progress is not None:
        progress += query.recentProgress
    return spark.table(name).filter("conn_id <> 99")


def test_streamed_commits_equal_the_batch_form_and_state_goes(spark, stream_files):
    df, folder = stream_files
    live.use_rocksdb(spark)
    progress = []
    got = run_stream(spark, folder, live.stream_commit_units, "units", progress=progress)
    want = m.commit_units(df).select("conn_id", "unit", "chunks", "bytes", "commit_seq")
    assert collected(got) == collected(want)
    held = [p.stateOperators[0].numRowsTotal for p in progress if p.stateOperators]
    # After a day of silence nothing of the nine connections is left: what remains is the
    # last one's message and its timer.
    assert max(held) >= 18 and held[-1] == 2


def test_streamed_texts_equal_the_batch_form(spark, stream_files):
    df, folder = stream_files
    live.use_rocksdb(spark)
    got = run_stream(spark, folder, live.stream_resolved_texts, "texts")
    assert collected(got) == collected(m.resolved_texts(df))


def test_streamed_outcomes_equal_the_batch_form_with_open_attempts(spark, stream_files):
    df, folder = stream_files
    live.use_rocksdb(spark)
    order = (m.PARTIAL, m.KEEPALIVE, m.FINAL)
    got = run_stream(spark, folder, lambda s: live.stream_attempt_outcomes(s, 300, order), "outcomes")
    want = m.attempt_outcomes(df, 300).join(m.handshake_order(df, order), ["conn_id", "attempt"])
    text = [F.coalesce(c, F.lit("-")).alias(c) for c in ("error_type", "error_message")]
    columns = ["conn_id", "attempt", "status", *text, "in_order"]
    assert collected(got.select(*columns)) == collected(want.select(*columns))
    assert got.filter("error_type = 'timeout'").count() > 0 and got.filter("in_order").count() > 0
    assert got.filter("error_type = 'client_error'").count() > 0


def test_streamed_timeouts_need_no_message_of_their_own(spark, tmp_path):
    waits = [
        (1, 0, m.KEEPALIVE, {}), (1, 1, m.COMMIT, {}), (1, 5, m.KEEPALIVE, {}), (1, 9, m.KEEPALIVE, {}),
        (1, 70, m.KEEPALIVE, {}), (1, 71, m.DONE, {}), (1, 200, m.COMMIT, {}), (1, 250, m.DONE, {}),
        (1, 400, m.APPEND, {}), (2, 10, m.COMMIT, {}), (2, 20, m.KEEPALIVE, {}), (3, 10, m.KEEPALIVE, {}),
        (4, 410, m.COMMIT, {}), (4, 430, m.ERROR, {}), (4, 440, m.COMMIT, {}), (4, 500, m.COMMIT, {}),
    ]
    df = make(spark, waits)
    parts = sorted((tuple(r) for r in df.collect()), key=lambda r: r[2])
    live.use_rocksdb(spark)
    write_batches(spark, tmp_path, [parts[1::2] + parts[4:6], parts[::2]])  # some come twice
    got = run_stream(spark, tmp_path, lambda s: live.stream_timeouts(s, 60, "10 minutes", "2 hours"), "waits")
    columns = ("conn_id", "status", "error_type", "wait_after_commit", "keepalive_count")
    want = m.timeouts(df, 60, until=START + dt.timedelta(days=9))
    assert collected(got.select(*columns)) == collected(want.select(*columns))
    assert collected(got.select("conn_id", "last_seq")) == [(1, 3), (2, 10), (4, 15)]


def test_streamed_stages_equal_the_batch_form(spark, stream_files):
    df, folder = stream_files
    live.use_rocksdb(spark)
    kinds = dict(connected=m.KEEPALIVE, streamed=m.APPEND, committed=m.COMMIT, received=m.FINAL)
    ends = [m.FINAL, m.ERROR]
    got = run_stream(spark, folder, lambda s: live.stream_latency_stages(s, **kinds, ends=ends), "stages")
    want = m.latency_stages(df, **kinds, ends=ends)
    assert got.columns == want.columns and len(got.columns) == 10
    plain = lambda d: sorted(map(str, collected_rows(d)))
    assert plain(got) == plain(want) and got.count() > 20
    with pytest.raises(ValueError):
        live.stream_latency_stages(df, **kinds, ends=[m.ERROR])


def collected_rows(df):
    return [tuple(r) for r in df.collect()]


def test_a_connection_that_speaks_again_after_its_ttl_begins_anew(spark, tmp_path):
    rows = [(1, 0, m.APPEND, audio(4)), (1, 1, m.COMMIT, {}), (1, 10, m.APPEND, audio(2)),
            (1, 9000, m.APPEND, audio(3)), (1, 9001, m.COMMIT, {})]
    live.use_rocksdb(spark)
    write_batches(spark, tmp_path, [[tuple(r)] for r in make(spark, rows).collect()])
    got = run_stream(spark, tmp_path, lambda s: live.stream_commit_units(s, "1 minute", "1 hour"), "anew")
    assert collected(got) == [(1, 0, 1, 3, 4), (1, 0, 1, 4, 1)]


def test_streamed_settings_equal_the_batch_form(spark, stream_files):
    df, folder = stream_files
    got = run_stream(spark, folder, live.stream_settings, "settings", "complete")
    want = m.session_settings(df)
    assert collected(got) == collected(want)


def test_streamed_keepalives_and_silences(spark, stream_files):
    df, folder = stream_files
    got = run_stream(spark, folder, lambda s: live.stream_keepalives(s, "10 minutes", "1 minute"),
                     "alive", "complete")
    total = df.filter(F.col("type") == m.KEEPALIVE).count()
    assert got.agg(F.sum("keepalive_count")).first()[0] == total
    sessions = run_stream(spark, folder, lambda s: live.stream_silences(s, "2 minutes", "1 minute"),
                          "sessions", "complete")
    batch = live.stream_silences(df, "2 minutes")
    assert collected(sessions) == collected(batch)
    for block in (50, m.BLOCK_ROWS):
        assert collected(m.activity_sessions(df, 120, block).drop("session")) == collected(batch)


def test_resume_sink_never_redoes_a_success(spark, tmp_path):
    sink = live.resume_sink(str(tmp_path / "out"))
    schema = "file string, status string, n int"
    sink(spark.createDataFrame([("a", "success", 1), ("b", "failed", 1)], schema), 0)
    second = spark.createDataFrame([("a", "success", 2), ("b", "success", 2), ("c", "failed", 2)], schema)
    for _ in range(2):  # a repeated batch replaces its own output
        sink(second, 1)
    got = spark.read.parquet(str(tmp_path / "out")).select("file", "status", "n")
    assert collected(got) == [("a", "success", 1), ("b", "failed", 1), ("b", "success", 2), ("c", "failed", 2)]

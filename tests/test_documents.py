import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from uttermark.operators import summary
from uttermark.plans.bindings import judged
from uttermark.sources import sinks


def test_a_document_is_written_in_order_and_whole(spark, tmp_path):
    rows = spark.createDataFrame([(f"f{i}", float(i % 50), None if i == 7 else i / 4) for i in range(300)], "file string, v double, c double")
    cells = sinks.cells(("File", "V", "C"), ("file", sinks.signed_text(F.col("v"), 1), sinks.number_text(F.col("c"))))
    few = spark.createDataFrame([("a|b",), ("c",)], "file string")
    lines = sinks.document(
        [
            sinks.Section("All", rows, cells, [-F.col("v"), F.col("file")]),
            sinks.Section("Few", few, sinks.cells(("File",), ("file",)), [F.col("file")]),
            sinks.Section("None", few.limit(0), sinks.cells(("File",), ("file",)), []),
        ]
    )
    sinks.write_document(lines.repartition(5), str(tmp_path / "out"))
    text = [line for p in sorted((tmp_path / "out").glob("part-*")) for line in p.read_text().splitlines()]
    want = sorted(((-float(i % 50), f"f{i}", i) for i in range(300)))
    body = [f"| {name} | {-v:+.1f} | {'N/A' if i == 7 else f'{i / 4:.2f}'} |" for v, name, i in want]
    head = lambda title, n: [f"## {title}", "", "| " + " | ".join(n) + " |", "|" + " --- |" * len(n)]
    assert text == head("All", ["File", "V", "C"]) + body + head("Few", ["File"]) + ["| a\\|b |", "| c |"] + head("None", ["File"])
    with pytest.raises(ValueError):
        sinks.document([sinks.Section("x", few, {}, [F.col("file")] * 4)])


def test_the_summary_document_nests_files_and_runs(spark):
    schema = (
        "seq bigint, engine string, file string, run_id string, status string, cer_bp bigint, inference_rtf double, "
        "has_hallucination boolean, severity string, primary_error string, review_status string, "
        "has_timestamp boolean, transcript_hash string"
    )
    rows = [
        (i, "a" if i % 3 else "b", f"f{i % 4}", f"r{i % 2}", "failed" if i == 5 else "success", None if i == 6 else 1000 * (i % 7),
         i / 10, i % 2 == 0, "high" if i % 4 == 0 else "none", "insertion" if i % 2 == 0 else "none", "auto_accept", i % 4 != 1, f"h{i % 5}")
        for i in range(24)
    ]
    rows.append((99, "b", None, None, None, 500, None, False, None, None, None, False, None))
    records = spark.createDataFrame(rows, schema)
    audio = spark.createDataFrame([("f1", 0.5, ["quiet"])], "file string, avg_rms double, reasons array<string>")
    excerpts = spark.createDataFrame([("f2", "hello")], "file string, excerpt string")
    segments = spark.createDataFrame([("f1", "A", 1.5), ("f1", "B", None)], "file string, speaker string, dur double")
    extras = summary.file_extras(audio, excerpts, segments)
    got = {r.engine: json.loads(r.document) for r in summary.summary_documents(records, seed=1, replicas=20, extras=extras).collect()}
    assert set(got) == {"a", "b"}
    mine = [r for r in rows if r[1] == "a"]
    top = got["a"]["engine_summary"]
    assert top["records"] == len(mine) and top["status_counts"] == {"failed": 1, "success": len(mine) - 1}
    assert top["severity_counts"]["high"] == sum(r[8] == "high" for r in mine)
    assert top["cer_all"]["count"] == len(mine) and top["cer_all"]["ci_low"] <= top["cer_all"]["mean"] <= top["cer_all"]["ci_high"]
    f1 = got["a"]["engine_file_summary"]["f1"]
    assert f1["audio"] == {"avg_rms": 0.5, "reasons": ["quiet"]} and f1["rttm"]["segments"] == 2 and f1["rttm"]["voiced_seconds"] == 1.5
    assert got["a"]["engine_file_summary"]["f2"]["timestamp_excerpt"] == "hello" and sum(f1["quality_tiers"].values()) == f1["runs"]
    assert set(got["a"]["engine_run_summary"]) == {"r0", "r1"}
    assert got["b"]["engine_file_summary"]["unknown"]["runs"] == 1 and "unknown" in got["b"]["engine_run_summary"]
    assert got["b"]["engine_summary"]["primary_error_counts"]["unknown"] == 1


def test_documents_of_many_names_come_in_parts(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1 + i % 9), i % 40, ("click", "view")[i % 2], 1.0 * (i % 5), '{"k": 45}') for i in range(300)]
    spark.createDataFrame(
        rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    ).write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    facts = judged(spark, str(tmp_path))
    whole = {r.engine: json.loads(r.document) for r in summary.summary_documents(facts, seed=1, replicas=2).collect()}
    pieces = [(r.engine, json.loads(r.document))
              for r in summary.summary_documents(facts, seed=1, replicas=2, most_names=3).collect()]
    assert len(pieces) == 14  # of 20 files each
    joined = {}
    for engine, piece in pieces:
        one = joined.setdefault(engine, {"engine_summary": piece["engine_summary"]})
        assert piece["engine_summary"] == whole[engine]["engine_summary"]
        for level in ("engine_file_summary", "engine_run_summary"):
            own = piece.get(level, {})
            assert not own.keys() & one.setdefault(level, {}).keys()
            one[level] |= own
    assert joined == whole

import json

import pytest
from pyspark.sql import functions as F

from uttermark.operators import checks, matching, rollup, runlog
from uttermark.sources import readers, run_tree, sinks


@pytest.fixture
def runs(tmp_path):
    root = tmp_path / "lab"
    ok = {"file": "a (1).mp3", "status": "success", "transcript": "日本", "duration": 2.0, "total_rtf": 0.5,
          "inference_rtf": 0.25, "bytes_sent": -1, "rf": 0, "cer": "65.49%"}
    bad = {"file": "b.wav", "status": "failed", "error_type": "timeout"}
    other = {"file": "b.wav", "status": "success", "engine": "beta", "profile": "raw", "bytes_sent": 10}
    for engine, run, rows in [
        ("alpha", "19-04-2026_v2", [ok, bad]), ("alpha", "19-04-2026_v10", [ok]),
        ("alpha", "notes_v1", [ok]), ("alpha", "20-04-2026 x", [bad]), ("beta", "20-04-2026_v1", [other]),
    ]:
        folder = root / engine / run
        folder.mkdir(parents=True)
        (folder / "results.json").write_text(json.dumps(rows, ensure_ascii=False, indent=2), encoding="utf-8")
    return root


def test_results(spark, runs):
    df = readers.read_results(spark, f"{runs}/*/*/results.json")
    assert df.count() == 5
    first = df.filter("run_id = '19-04-2026_v2' and file like 'a%'").first()
    assert (first["engine"], first["run_version"], str(first["run_date"])) == ("alpha", 2, "2026-04-19")
    assert first["bytes_sent"] is None and first["cer_bp"] == 6549 and first["transcript"] == "日本"
    odd = df.filter("run_id = '20-04-2026 x'").first()
    assert odd["run_date"] is None and odd["run_version"] == 0
    assert readers.select_runs(df, low=3).select("run_id").distinct().collect()[0][0] == "19-04-2026_v10"
    assert readers.select_runs(df, high=2).count() == 3
    assert readers.select_runs(df, date="2026-04-19").count() == 3
    assert readers.select_runs(df, runs=["20-04-2026_v1", "gone"]).count() == 1
    latest = df.groupBy("engine").agg(F.max("run_version")).collect()
    assert dict(map(tuple, latest)) == {"alpha": 10, "beta": 1}


def test_references_and_texts(spark, tmp_path):
    (tmp_path / "gt.json").write_text(json.dumps({"a.mp3": "x\ny", "b.mp3": "é"}), encoding="utf-8")
    got = sorted(map(tuple, readers.read_references(spark, str(tmp_path / "gt.json")).collect()))
    assert got == [("a.mp3", "x\ny", 0), ("b.mp3", "é", 1)]
    folder = tmp_path / "timed"
    folder.mkdir()
    (folder / "m 1+2 (1).txt").write_text("[0 - 1] SPEAKER 1: hi\n[1 - 2] SPEAKER 2: yo", encoding="utf-8")
    rows = readers.read_text_files(spark, f"{folder}/*.txt").collect()
    assert [tuple(r) for r in rows] == [("m 1+2 (1).txt", "[0 - 1] SPEAKER 1: hi\n[1 - 2] SPEAKER 2: yo")]


def test_verdict_csv(spark, tmp_path):
    folder = tmp_path / "alpha" / "19-04-2026_v1"
    folder.mkdir(parents=True)
    head = ",".join(readers.schemas.VERDICT_COLUMNS)
    body = 'a.mp3,True,insertion,high,low,auto_accept,65.49%,0,1.5,"two\nlines, ""quoted""",h,g\n' \
           ",False,none,none,low,auto_accept,,,,x,,\n"
    (folder / "details.csv").write_text("\ufeff" + head + "\n" + body, encoding="utf-8")
    rows = readers.read_verdicts(spark, f"{tmp_path}/*/*/details.csv").collect()
    assert len(rows) == 1
    assert rows[0]["has_hallucination"] is True and rows[0]["filename"] == "a.mp3"
    assert rows[0]["reasoning"] == 'two\nlines, "quoted"' and rows[0]["existing_inference_rtf"] == 1.5


def test_summaries_quality_segments_logs(spark, tmp_path):
    folder = tmp_path / "alpha" / "19-04-2026_v1"
    folder.mkdir(parents=True)
    (folder / "summary.json").write_text(json.dumps(
        {"run_dir": "r", "hallucination_rate": 0.5, "error_distribution": {"none": 3, "insertion": 1},
         "existing_metrics": {"avg_cer": "40.00%", "avg_inference_rtf": 1.5, "hrs": 0.0}}, indent=1))
    row = readers.read_summaries(spark, f"{tmp_path}/*/*/summary.json").first()
    assert row["error_distribution"] == {"none": 3, "insertion": 1}
    assert row["existing_metrics"]["avg_cer"] == "40.00%"
    (tmp_path / "q.json").write_text(json.dumps([{"file": "a", "avg_rms": 0.1, "reasons": ["x"]}], indent=1))
    assert readers.read_audio_quality(spark, str(tmp_path / "q.json")).first()["reasons"] == ["x"]
    (tmp_path / "s.rttm").write_text(
        "SPEAKER f 1 0.5  1.25 <NA> <NA> spk0 <NA> <NA>\nSPEAKER f 1 2 bad <NA> <NA> spk1\nshort line\n\n")
    segs = readers.read_segments(spark, str(tmp_path / "s.rttm")).collect()
    assert [(s["dur"], s["speaker"]) for s in segs] == [(1.25, "spk0"), (None, "spk1")]
    (tmp_path / "run.log").write_text("one\ntwo\nthree")
    log = readers.read_log(spark, str(tmp_path / "run.log"))
    assert [r["line"] for r in log.orderBy("line_no").collect()] == ["one", "two", "three"]
    assert [r["line"] for r in runlog.tail(log, "line_no", 2).collect()] == ["two", "three"]
    (tmp_path / "40-13-2026_v1").mkdir()
    (tmp_path / "40-13-2026_v1" / "results.json").write_text('[{"file": "a"}]')
    odd = readers.read_results(spark, str(tmp_path / "*" / "results.json")).collect()
    assert [(r["run_id"], r["run_date"]) for r in odd] == [("40-13-2026_v1", None)]


def test_media_scan(spark, tmp_path):
    for name in ("a.MP3", "b.txt", "c.flac"):
        (tmp_path / name).write_bytes(b"x")
    got = sorted(r["file"] for r in readers.scan_media(spark, str(tmp_path)).collect())
    assert got == ["a.MP3", "c.flac"]


def test_append_and_resume(spark, tmp_path):
    path = str(tmp_path / "res")
    schema = "engine string, run_id string, file string, status string"
    sinks.append_results(spark.createDataFrame([("e", "r", "a", "success"), ("e", "r", "b", "failed")], schema), path)
    media = spark.createDataFrame([("a",), ("b",), ("c",)], "file string")
    todo = matching.pending(media, spark.read.parquet(path))
    sinks.append_results(todo.selectExpr("'e' engine", "'r' run_id", "file", "'success' status"), path)
    done = spark.read.parquet(path)
    assert done.count() == 4 and matching.pending(media, done).count() == 0
    sinks.write_metrics(done, str(tmp_path / "v2"))
    assert spark.read.parquet(str(tmp_path / "v2")).count() == 4


def test_verdict_export_round_trip(spark, tmp_path):
    schema = ", ".join(f"{c} " + ("boolean" if c == "has_hallucination" else "string")
                       for c in readers.schemas.VERDICT_COLUMNS)
    row = ("a.mp3", True, "none", "low", "low", "auto_accept", "1%", "0", "0.5", 'q "x"\nnext', None, "g")
    out = tmp_path / "alpha" / "19-04-2026_v1"
    out.parent.mkdir()
    df = spark.createDataFrame([row], schema)
    assert sinks.export_verdicts(df, str(out))
    assert not sinks.export_verdicts(df.filter("1 = 0"), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    back = readers.read_verdicts(spark, f"{tmp_path}/*/*/*.csv").first()
    assert (back["filename"], back["has_hallucination"], back["reasoning"]) == ("a.mp3", True, 'q "x"\nnext')
    raw = [f.read_text(encoding="utf-8") for f in out.glob("*.csv")]
    assert all(r.startswith("\ufefffilename,") for r in raw) and any(",True," in r for r in raw)


def test_records_export_order(spark, tmp_path):
    rows = [("b", "19-04-2026_v10", "x"), ("b", "19-04-2026_v2", "y"), ("b", "19-04-2026_v2", "x"), ("a", "19-04-2026_v3", "z")]
    df = spark.createDataFrame(rows, "engine string, run_id string, file string")
    sinks.export_records(df, str(tmp_path / "out"))
    files = sorted((tmp_path / "out").glob("part-*.csv"))
    lines = [line for f in files for line in f.read_text().splitlines()[1:]]
    assert [tuple(line.split(",")[:3]) for line in lines] == [
        ("a", "19-04-2026_v3", "z"), ("b", "19-04-2026_v2", "x"), ("b", "19-04-2026_v2", "y"), ("b", "19-04-2026_v10", "x"),
    ]
    assert len(files[0].read_text().splitlines()[0].split(",")) == 22
    sinks.export_json(df.limit(1), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 1


def test_markdown(spark):
    df = spark.createDataFrame([("a|b", 1.005, None), ("c", 2.0, -0.5)], "f string, x double, d double")
    text = sinks.to_markdown(
        df, {"File": F.col("f"), "X": sinks.percent_cell(F.col("x")), "Diff": sinks.signed_text(F.col("d"))},
        [F.col("f")], 10)
    assert text.splitlines() == [
        "| File | X | Diff |", "| --- | --- | --- |", "| a\\|b | 1.0% | - |", "| c | 2.0% | -0.500 |",
    ]
    got = df.select(sinks.interval_text(F.lit(0.398), F.lit(0.504)), sinks.number_text(F.lit(float("nan")))).first()
    assert tuple(got) == ("39.8% … 50.4%", "N/A")


def test_unified_records_from_files(spark, runs, tmp_path):
    head = ",".join(readers.schemas.VERDICT_COLUMNS)
    (runs / "alpha" / "19-04-2026_v2" / "details.csv").write_text(
        head + "\na (1).mp3,True,insertion,high,low,auto_accept,65.49%,0,0.25,why,ev,ctx\n", encoding="utf-8")
    quality = spark.createDataFrame([("b.wav", 0.5, ["x"])], "file string, avg_rms double, reasons array<string>")
    facts = matching.unified_records(
        readers.read_results(spark, f"{runs}/*/*/results.json"),
        readers.read_verdicts(spark, f"{runs}/*/*/details.csv"),
        quality,
        spark.createDataFrame([("a_(1)",)], "name string"),
        spark.createDataFrame([("a",)], "name string"),
    )
    got = {(r["run_id"], r["file"]): r for r in facts.collect()}
    assert len(got) == 5
    hit = got[("19-04-2026_v2", "a (1).mp3")]
    assert hit["has_hallucination"] and hit["severity"] == "high" and hit["reasoning"] == "why"
    assert hit["has_timestamp"] and hit["has_rttm"] and hit["transcript_length"] == 2
    other = got[("19-04-2026_v10", "a (1).mp3")]
    assert other["severity"] == "unknown" and not other["has_hallucination"]
    assert got[("19-04-2026_v2", "b.wav")]["reasons"] == ["x"]
    assert not got[("19-04-2026_v2", "b.wav")]["has_timestamp"]
    sinks.export_records(facts, str(tmp_path / "records"))
    grains = rollup.grains(facts).filter("grain = 'engine'").collect()
    assert {r["engine"]: r["records"] for r in grains} == {"alpha": 4, "beta": 1}


def test_the_last_of_repeated_references_and_verdicts_counts(spark, tmp_path):
    (tmp_path / "gt.json").write_text('{"a.mp3": "z first", "b.mp3": "b", "a.mp3": "a last"}', encoding="utf-8")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    refs = readers.read_references(spark, str(tmp_path / "gt.json"))
    results = spark.createDataFrame([("a.mp3",), ("c.mp3",)], "file string")
    got = matching.match_exact(results, refs).collect()
    spark.conf.unset("spark.sql.mapKeyDedupPolicy")
    assert sorted(map(tuple, got)) == [("a.mp3", "a last"), ("c.mp3", None)]
    folder = tmp_path / "alpha" / "19-04-2026_v1"
    folder.mkdir(parents=True)
    lines = [f"m{i % 7}.mp3,True,insertion,{'high' if i >= 93 else 'none'},low,auto_accept,,,,\"x\n{i}\",," for i in range(100)]
    (folder / "d.csv").write_text("\n".join([",".join(readers.schemas.VERDICT_COLUMNS), *lines]), encoding="utf-8")
    verdicts = readers.read_verdicts(spark, f"{tmp_path}/alpha/*/*.csv")
    last = matching.last_of(verdicts.select("filename", "severity", "reasoning", "line"), ["filename"]).collect()
    assert len(last) == 7 and {r["severity"] for r in last} == {"high"}
    assert {int(r["reasoning"].split()[1]) for r in last} == set(range(93, 100))


def test_run_tree_reads_only_the_runs_asked_for(spark, runs):
    # Whatever is not asked for is broken, so that reading it would show.
    for name, text in [("21-04-2026_v1", "{no json"), ("21-04-2026_v3", '{"file": "an object"}'), ("22-04-2026_v1", "")]:
        folder = runs / "alpha" / name
        folder.mkdir()
        (folder / "results.json").write_text(text, encoding="utf-8")
    (runs / "beta" / "23-04-2026_v1").mkdir()
    (runs / "beta" / "20-04-2026_v1" / "results.json").write_text(
        json.dumps([{"file": "x", "duration": "long", "rf": 2**40, "delay_ms": 5.0, "profile": {"a": 1}}, 7]), encoding="utf-8")
    tree = run_tree.read_run_tree(spark, str(runs))
    plain = readers.read_results(spark, f"{runs}/*/*/results.json")
    assert set(plain.columns) | {"corrupt"} == set(tree.columns)
    read = lambda **asked: run_tree.read_run_tree(spark, str(runs), **asked)
    asked = read(engines=["alpha"], date="2026-04-19")
    assert asked.rdd.getNumPartitions() == 2 and asked.filter("corrupt is not null").count() == 0
    columns = [c for c in plain.columns if c != "corrupt"]
    want = readers.select_runs(plain.filter("engine = 'alpha'"), date="2026-04-19").select(*columns)
    assert sorted(map(str, asked.select(*columns).collect())) == sorted(map(str, want.collect()))
    names = lambda df: sorted(r.run_id for r in df.select("run_id").distinct().collect())
    for chosen in ({"low": 3}, {"high": 2}, {"low": 2, "high": 3}, {"runs": ["20-04-2026_v1", "gone"]}, {"date": "2026-04-21"}):
        part = read(**chosen)
        assert names(part) == names(readers.select_runs(tree, **chosen)) != []
    assert read(low=3, high=10).rdd.getNumPartitions() == 2
    assert read(engines=["gone"]).count() == 0 and tree.rdd.getNumPartitions() == 8
    odd = tree.filter("run_id = '20-04-2026 x'").first()
    assert odd["run_date"] is None and odd["run_version"] == 0 and odd["corrupt"] is None
    broken = {r["run_id"] + ":" + str(r["file"]): r["corrupt"] for r in tree.filter("corrupt is not null").collect()}
    assert broken["20-04-2026_v1:x"] == "duration: not double; rf: not int"
    assert broken["20-04-2026_v1:None"] == "element: not an object"
    assert all(broken[f"{v}:None"].startswith("file: ") for v in ("21-04-2026_v1", "21-04-2026_v3", "22-04-2026_v1"))
    kept = tree.filter("file = 'x'").first()
    assert kept["delay_ms"] == 5 and kept["profile"] == '{"a": 1}' and kept["duration"] is None


def files_of(folder):
    return {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_write_back_leaves_the_files_of_other_runs(spark, tmp_path):
    path = str(tmp_path / "results")
    rows = [("a", f"r{run}", f"f{i}", i / 4, None) for run in range(10) for i in range(5)]
    df = spark.createDataFrame(rows, "engine string, run_id string, file string, v double, cer double")
    sinks.append_results(df, path)
    before = files_of(tmp_path)
    score = F.when(F.col("run_id").isin("r3", "r7"), F.col("v") * 2)
    want = sorted(map(str, df.withColumn("cer", score).collect()))
    stored = spark.read.parquet(path)
    runs = sinks.changed_runs(stored, stored.withColumn("cer", score))
    assert sorted(r["run_id"] for r in runs.collect()) == ["r3", "r7"]
    assert sinks.changed_runs(stored, stored.union(stored.filter("file = 'f1' and run_id = 'r1'"))).count() == 1
    asked = spark.createDataFrame([("a", "r3"), ("a", "r7")], "engine string, run_id string")
    for chosen in (runs, asked):  # a repeated batch leaves the same rows
        scored = spark.read.parquet(path).withColumn("cer", score)
        sinks.write_back(scored, path, chosen)
        now = files_of(tmp_path)
        assert {p.parent.name for p in set(before) ^ set(now)} == {"run_id=r3", "run_id=r7"}
        assert all(now[p] == t for p, t in before.items() if p.parent.name not in ("run_id=r3", "run_id=r7"))
        assert sorted(map(str, spark.read.parquet(path).select(*df.columns).collect())) == want


def test_a_failed_rule_keeps_the_version_out_of_place(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i == 3 else i / 2) for i in range(10)], "id int, v double")
    rules = {"v is known": F.col("v").isNotNull(), "id is small": F.col("id") < 9}
    with pytest.raises(checks.ExpectationFailed, match="v is known: 1, id is small: 1"):
        sinks.write_checked(df, str(tmp_path / "out"), rules)
    assert list(tmp_path.iterdir()) == []
    good = df.filter("v is not null and id < 9")
    assert sinks.write_checked(good, str(tmp_path / "out"), rules) == {"rows": 8}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
    with pytest.raises(FileExistsError):
        sinks.write_checked(good, str(tmp_path / "out"), rules)

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from uttermark.functions import text
from uttermark.functions.text import canonical_stem, file_stem, timed_aliases
from uttermark.operators import (
    bootstrap, checks, compare, judge, matching, quantiles, rollup, runlog, scan, scoring, stability,
    superiority, triage,
)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# A third of all rows belong to one key, as in the worst case the design allows for.
def hot_rows(n=600, seed=3):
    rng = random.Random(seed)
    keys = ["hot" if i % 3 == 0 else f"k{rng.randrange(20)}" for i in range(n)]
    return [(k, i * 7 % 1009, rng.choice([None, 1.5, -2.0, 0.0, rng.gauss(10, 40)])) for i, k in
            enumerate(keys)]


@pytest.mark.parametrize("block_rows", [5, 100, scan.BLOCK_ROWS])
def test_running_equals_a_plain_window(spark, block_rows):
    data = hot_rows()
    df = spark.createDataFrame(data, "key string, seq long, v double")
    got = scan.running(
        df, ["key"], "seq", sums={"n": F.lit(1).cast("bigint")}, lasts={"prev": F.col("v")},
        totals={"total": F.lit(1).cast("bigint")}, block_rows=block_rows,
    )
    sizes = pd.Series([k for k, _, _ in data]).value_counts()
    assert all(r.total == sizes[r.key] for r in got.collect())
    result = {(r.key, r.seq): (r.n, r.prev) for r in got.collect()}
    assert len(result) == len(data)
    frame = pd.DataFrame(data, columns=["key", "seq", "v"]).sort_values("seq")
    for key, part in frame.groupby("key"):
        last = None
        for i, (seq, v) in enumerate(zip(part["seq"], part["v"]), 1):
            n, prev = result[(key, seq)]
            assert n == i and prev == last
            last = last if pd.isna(v) else v


def test_value_bins_keep_the_order(values):
    rng = random.Random(1)
    xs = sorted([0.0, 1e-9, -1e-9, 1e300, -1e300, math.inf, -math.inf]
                + [rng.gauss(0, 10 ** rng.randrange(-3, 6)) for _ in range(2000)])
    bins = [r[0] for r in values("v double", [(x,) for x in xs], scan.value_bin(F.col("v")))]
    assert bins == sorted(bins)


def test_quantiles_match_numpy(spark):
    data = hot_rows(900) + [(None, 5000 + i, float(i)) for i in range(7)] + [("nan", 1, math.nan)]
    df = spark.createDataFrame(data, "key string, seq long, v double")
    qs = {"q0": 0.0, "q15": 0.15, "med": 0.5, "p95": 0.95, "q1": 1.0}
    got = {r["key"]: r for r in quantiles.exact_quantiles(df, ["key"], "v", qs).collect()}
    assert "nan" not in got and None in got
    for key in got:
        vals = [v for k, _, v in data if k == key and v is not None and not math.isnan(v)]
        for name, q in qs.items():
            assert got[key][name] == pytest.approx(np.percentile(vals, q * 100), abs=1e-9)


def brute(lefts, rights):
    pairs = [(a, b) for a in lefts for b in rights]
    n = len(pairs)
    return (float(n), sum(a < b for a, b in pairs) / n, sum(a > b for a, b in pairs) / n,
            sum(a == b for a, b in pairs) / n)


def test_superiority_matches_all_pairs(spark):
    rng = random.Random(5)
    data = [
        (key, side, rng.choice([rng.gauss(0, 3), float(rng.randrange(-3, 4))]))
        for key, n in [("hot", 300), ("a", 30), ("b", 2)] for side in "LR" for _ in range(n)
    ] + [("one", "L", 1.0), ("t", "L", 2.0), ("t", "R", 2.0), ("a", "L", None)]
    df = spark.createDataFrame(data, "key string, side string, v double")
    sides = {"left": (F.col("side") == "L").cast("int"), "right": (F.col("side") == "R").cast("int")}
    got = {r[0]: tuple(r)[1:] for r in superiority.superiority(df, ["key"], "v", **sides).collect()}
    assert got.pop("one") == (0.0, None, None, None)
    for key, result in got.items():
        want = brute(*[[v for k, s, v in data if k == key and s == x and v is not None] for x in "LR"])
        assert result == pytest.approx(want)
        assert sum(result[1:]) == pytest.approx(1)
    overall = tuple(superiority.superiority(df, [], "v", **sides).first())
    assert overall == pytest.approx(
        brute(*[[v for _, s, v in data if s == x and v is not None] for x in "LR"])
    )


def test_bootstrap_is_reproducible_and_brackets_the_mean(spark):
    rng = random.Random(2)
    data = [("small", i, rng.gauss(50, 10)) for i in range(30)]
    data += [("large", i, rng.gauss(50, 10)) for i in range(500)]
    data += [("single", 1, 42.0)]
    df = spark.createDataFrame(data, "key string, id long, v double")
    args = (df, ["key"], "v", "id")
    one = sorted(rows_of(bootstrap.bootstrap_mean(*args, seed=9, replicas=400)))
    two = sorted(rows_of(bootstrap.bootstrap_mean(
        df.repartition(3, "v"), ["key"], "v", "id", seed=9, replicas=400)))
    assert [r[0] for r in one] == [r[0] for r in two]
    assert [r[1:] for r in one] == [pytest.approx(r[1:]) for r in two]
    drawn = {r[0]: r[1:] for r in rows_of(bootstrap.bootstrap_mean(*args, seed=9, replicas=400, method="draws"))}
    assert drawn["single"] == (42.0, 42.0)
    ci = {k: (lo, hi) for k, lo, hi in one}
    assert drawn["large"] == pytest.approx(ci["large"], rel=0.02)
    assert ci["single"] == (42.0, 42.0)
    for key, n in [("small", 30), ("large", 500)]:
        vals = [v for k, _, v in data if k == key]
        se = np.std(vals) / math.sqrt(n)
        lo, hi = ci[key]
        assert lo < np.mean(vals) < hi
        assert (hi - lo) == pytest.approx(2 * 1.96 * se, rel=0.25)
    other = {r[0]: r[1:] for r in rows_of(bootstrap.bootstrap_mean(*args, seed=10, replicas=400))}
    assert other["large"] != ci["large"]


def test_draws_and_weights_are_even(spark):
    df = spark.createDataFrame([("s", i, float(i)) for i in range(50)], "key string, id long, v double")
    small = bootstrap.resample(df, ["key"], "v", "id", seed=1, replicas=400, method="draws")
    counts = dict(rows_of(small.groupBy("value").count()))
    assert len(counts) == 50 and min(counts.values()) > 300 and max(counts.values()) < 510
    large = bootstrap.resample(df, ["key"], "v", "id", seed=1, replicas=400)
    mean, var = large.agg(F.avg("weight"), F.var_pop("weight")).first()
    assert mean == pytest.approx(1, abs=0.03) and var == pytest.approx(1, abs=0.06)


def test_repeated_values_get_one_draw_of_their_number(spark):
    data = [("s", i, float(i < 300)) for i in range(340)]  # 300 rows of 1.0, 40 of 0.0
    df = spark.createDataFrame(data, "key string, id long, v double")
    drawn = bootstrap.resample(df, ["key"], "v", "id", seed=5)
    assert drawn.count() == 2 * bootstrap.REPLICAS
    moments = {r[0]: r[1:] for r in rows_of(drawn.groupBy("value").agg(
        F.avg("weight"), F.var_pop("weight"), F.min("weight")))}
    for value, n in ((1.0, 300), (0.0, 40)):
        mean, variance, least = moments[value]
        assert mean == pytest.approx(n, rel=0.01) and variance == pytest.approx(n, rel=0.12) and least >= 0
    sides = drawn.groupBy("rep").pivot("value", [0.0, 1.0]).sum("weight")
    assert abs(sides.agg(F.corr("`0.0`", "`1.0`")).first()[0]) < 0.08  # drawn apart
    low, high = rows_of(bootstrap.bootstrap_mean(df, ["key"], "v", "id", seed=5))[0][1:]
    p = 300 / 340
    assert (high - low) == pytest.approx(2 * 1.96 * math.sqrt(p * (1 - p) / 340), rel=0.1) and low < p < high


def test_bootstrap_superiority(spark):
    data = [("f", s, i, 10.0 + i + (3 if s == "L" else 0)) for s in "LR" for i in range(12)]
    data += [("p", "L", 1, 2.0), ("p", "R", 1, 1.0), ("lone", "L", 1, 1.0)]
    df = spark.createDataFrame(data, "file string, side string, id long, v double")
    got = {r[0]: r[1:] for r in rows_of(bootstrap.bootstrap_superiority(
        df, ["file"], "v", "id", side="side", left="L", right="R", seed=3, replicas=300))}
    assert got["p"] == (1.0, 1.0) and "lone" not in got
    point = superiority.superiority(
        df.filter("file = 'f'"), ["file"], "v", left=(F.col("side") == "L").cast("int"),
        right=(F.col("side") == "R").cast("int")).first()["p_right"]
    assert got["f"][0] < point < got["f"][1]


def test_matching(spark):
    results = spark.createDataFrame(
        [("A (1).mp3", "success"), ("b.wav", "success"), ("c.wav", "failed"), ("", "success")],
        "file string, status string",
    )
    texts = spark.createDataFrame(
        [("x/a_(1).txt", "old", 1), ("A-(1).txt", "new", 2)], "name string, gt_timestamped string, o int"
    )
    timed = matching.reference_by_stem(texts, "name", "gt_timestamped", "o")
    plain = spark.createDataFrame([("b", "plain b")], "canonical_id string, gt_plain string")
    got = matching.evaluation_candidates(results, timed, plain)
    assert sorted(rows_of(got.select("file", "gt_timestamped", "gt_plain"))) == [
        ("A (1).mp3", "new", None), ("b.wav", None, "plain b"),
    ]
    names = spark.createDataFrame([("A_(1)",), ("b",)], "name string")
    found = matching.first_alias_match(results, "file", timed_aliases(file_stem(F.col("file"))), names)
    assert dict(rows_of(found)) == {"A (1).mp3": "A_(1)", "b.wav": "b"}
    media = results.select("file").distinct()
    assert [r[0] for r in matching.pending(media, results).collect()] == ["c.wav"]
    exact = matching.match_exact(
        results, spark.createDataFrame([("b.wav", "ref")], "file string, ref_text string"))
    assert dict(rows_of(exact.select("file", "ref_text")))["b.wav"] == "ref"
    assert exact.count() == 4
    verdicts = spark.createDataFrame(
        [("b.wav", True, "insertion", "high", "low", "auto_accept")],
        "file string, has_hallucination boolean, primary_error string, severity string, "
        "confidence string, review_status string")
    joined = {r["file"]: r for r in matching.with_verdicts(results, verdicts, ["file"]).collect()}
    assert joined["b.wav"]["severity"] == "high"
    assert joined["c.wav"]["severity"] == "unknown" and joined["c.wav"]["has_hallucination"] is False


def test_scoring_and_candidates(spark):
    schema = ("engine string, run_id string, file string, status string, transcript string, "
              "duration double, inference_rtf double")
    results = spark.createDataFrame(
        [("e", "r", "a.mp3", "success", "Hello!!!!! there", 10.0, 0.05), ("e", "r", "b.mp3", "success", "", 1.0, 0.05),
         ("e", "r", "c.mp3", "failed", None, None, None), ("e", "r", "silence.wav", "success", "x", 60.0, 0.05),
         ("e", "r", "d.mp3", "success", "zzzzzz", 1.0, None), ("e", "r", "quiet", "success", "", 1.0, 0.05)], schema)
    refs = spark.createDataFrame(
        [("a.mp3", "hello!!!!! there"), ("b.mp3", "words"), ("c.mp3", "w"), ("silence.wav", "x"), ("quiet", "。")],
        "file string, ref_text string")
    got = {r["file"]: (r["rf"], r["cer"], r["grade"]) for r in scoring.score_results(results, refs).collect()}
    assert got == {
        "a.mp3": (1, "0.00%", "S (Excellent)"), "b.mp3": (0, "N/A (Empty)", "F (Fail)"),
        "c.mp3": (0, "N/A", "ERROR"), "silence.wav": (0, "0.00%", "B (Fair)"),
        "d.mp3": (1, "N/A", "B"), "quiet": (0, "0.00%", "S (Excellent)"),
    }
    plain = spark.createDataFrame([("a", "ref a")], "canonical_id string, gt_plain string")
    timed = spark.createDataFrame([], "canonical_id string, gt_timestamped string")
    scored = scoring.score_results(results, refs)
    prompts = judge.build_prompts(matching.candidate_rows(matching.evaluation_candidates(scored, timed, plain)))
    kinds = dict(rows_of(prompts.select("filename", "reference_kind")))
    assert kinds["a.mp3"] == "plain" and kinds["d.mp3"] == "none" and "c.mp3" not in kinds


def test_missing_runs(spark):
    df = spark.createDataFrame(
        [("e", "a", "r1"), ("e", "a", "r2"), ("e", "b", "r2"), ("e", "a", "r1")],
        "engine string, file string, run_id string")
    assert rows_of(matching.missing_runs(df)) == [("e", "b", "r1")]


def test_last_wins_and_compare(spark):
    schema = "file string, seq long, status string, inference_rtf double, cer_bp long"
    left = spark.createDataFrame(
        [("a", 1, "success", 0.5, 1000), ("a", 2, "success", 0.7, 2000), ("l", 3, "success", 1.0, None)],
        schema)
    right = spark.createDataFrame([("a", 1, "success", None, 500), ("r", 2, "failed", 3.0, 1)], schema)
    got = {r["file"]: r for r in compare.compare_runs(left, right).collect()}
    assert got["a"]["rtf_diff"] == 0.7 and got["a"]["cer_diff"] == 15.0
    assert got["l"]["right_rtf"] is None and got["r"]["right_rtf"] is None
    labels = [spark.createDataFrame([(x,) for x in s], "label string") for s in ("aab", "bc")]
    hist = compare.compare_histograms(*labels, "label")
    assert sorted(rows_of(hist)) == [("a", 2, 0, 2), ("b", 1, 1, 0), ("c", 0, 1, -1)]


def test_rollup_labels(spark):
    df = spark.createDataFrame(
        [("e", "r1", "x", 1), ("e", "r1", "y", 2), ("e", "r2", "y", 3), ("e", "r2", "x", 4), ("e", "r3", "z", 5)],
        "engine string, run_id string, label string, pos long")
    assert rows_of(rollup.mode_by_first_seen(df, ["engine"], "label", "pos")) == [("e", "x", 2)]
    assert rows_of(rollup.mix_text(df, ["engine"], "label")) == [("e", "x:2, y:2, z:1")]
    means = dict(rows_of(rollup.cross_run_label_means(df, "label").select("label", "mean_count")))
    assert means == pytest.approx({"x": 2 / 3, "y": 2 / 3, "z": 1 / 3})


def test_mean_of_run_means_is_unweighted(spark):
    rows = [("e", "r1", "success", 1.0, None, 1000)] * 3 + [("e", "r2", "success", 3.0, 1.0, None),
            ("e", "r3", "failed", 9.0, 9.0, 9)]
    df = spark.createDataFrame(
        rows, "engine string, run_id string, status string, total_rtf double, inference_rtf double, cer_bp long")
    got = rollup.mean_of_run_means(df).first()
    assert (got["runs_passed"], got["runs_aggregated"]) == (3, 2)
    assert (got["avg_total_rtf"], got["avg_inference_rtf"], got["avg_cer"]) == (2.0, 0.5, 0.1)


def test_grains_add_up(spark):
    rows = [(e, f"f{i % 3}", f"r{i % 4}", i * 10, 0.5, i % 2 == 0, "high") for e in "ab" for i in range(24)]
    df = spark.createDataFrame(
        rows, "engine string, file string, run_id string, cer_bp long, inference_rtf double, "
        "has_hallucination boolean, severity string")
    totals = dict(rows_of(rollup.grains(df).groupBy("grain").agg(F.sum("records"))))
    assert totals == {"engine": 48, "file": 48, "run": 48}


def test_triage_rules(spark):
    rows = [
        ("e", "quiet", 0.0, 0.0, 0.1, 0.0, False, False), ("e", "bad", 85.0, 12.0, 2.5, 0.5, True, True),
        ("e", "fine", 1.0, 0.0, 0.1, 0.0, False, True), ("e", "fine2", 1.5, 0.0, 0.2, 0.0, False, True),
    ]
    df = spark.createDataFrame(
        rows, "engine string, file string, cer_mean double, cer_std double, rtf_mean double, "
        "high_severity_rate double, tier_changes boolean, has_timestamp boolean")
    got = triage.poor_cases(df).collect()
    assert [r["file"] for r in got] == ["bad"]
    assert got[0]["n_triggers"] == 9
    assert [r["place"] for r in triage.top_per_engine(triage.poor_cases(df), 1).collect()] == [1]


def test_stability(spark):
    df = spark.createDataFrame(
        [("f", 1, "x", None), ("f", 2, "x", None), ("g", 1, "y", None), ("g", 1, "y", 2.0)],
        "file string, a int, b string, c double")
    got = {r["field"]: tuple(r)[1:] for r in stability.field_stability(df, ["file"], ["a", "b", "c"]).collect()}
    assert got["a"] == (1, 1, "VOLATILE") and got["b"] == (2, 0, "PERFECTLY STABLE")
    assert got["c"] == (1, 1, "VOLATILE")
    wide = stability.pivot_runs(
        spark.createDataFrame([("f", "r1", 1, "a"), ("f", "r1", 2, "b")], "file string, run string, o int, c string"),
        ["file"], "run", ["r1", "r2"], F.col("c"), "o")
    assert rows_of(wide) == [("f", "b", "-")]


def test_run_log(spark):
    lines = spark.createDataFrame(
        [("l", 1, "New batch run: out/a"), ("l", 2, " Resuming batch in:  out/b "), ("l", 3, "x New batch run: c")],
        "log string, n int, line string")
    assert rows_of(runlog.run_dir_from_log(lines, ["log"], "n")) == [("l", "out/b")]
    assert [r["n"] for r in runlog.tail(lines, "n", 2).collect()] == [2, 3]
    used = spark.createDataFrame([("d", 1), ("d", 2), ("d", 4), ("e", 2)], "day string, v int")
    assert dict(rows_of(runlog.next_version(used, "day", "v"))) == {"d": 3, "e": 1}


VALID = '{"filename":"zzz","has_hallucination":true,"primary_error":"insertion","severity":"low",' \
        '"confidence":"high","review_status":"auto_accept","reasoning":"r"}'


def test_verdicts(spark):
    raws = [
        ("a", VALID), ("b", VALID.replace("insertion", "typo")), ("c", "not json"), ("d", None),
        ("e", '{"has_hallucination":false,"reasoning":"short"}'), ("f", '{"has_hallucination":"maybe","reasoning":"r"}'),
    ]
    df = spark.createDataFrame([(n, r, "51%", 1, 0.5) for n, r in raws],
                               "filename string, raw string, existing_cer string, existing_rf int, existing_inference_rtf double")
    got = {r["filename"]: r for r in judge.parse_verdicts(df).collect()}
    assert got["a"]["has_hallucination"] and not got["a"]["call_failed"]
    assert all(got[x]["call_failed"] and got[x]["review_status"] == "manual_review" for x in "bcdf")
    assert (got["e"]["call_failed"], got["e"]["confidence"], got["e"]["severity"]) == (False, "low", "none")
    assert got["e"]["existing_cer"] == "51%"


def test_override_is_strict(spark):
    rows = [("50%", False), ("50.01%", False), ("90%", True), ("N/A", False), (None, False)]
    df = spark.createDataFrame([(c, h, "auto_accept", "why") for c, h in rows],
                               "existing_cer string, has_hallucination boolean, review_status string, reasoning string")
    got = [r["review_status"] for r in judge.apply_override(df).collect()]
    assert got == ["auto_accept", "manual_review", "auto_accept", "auto_accept", "auto_accept"]
    assert judge.apply_override(df).collect()[1]["reasoning"].endswith(judge.OVERRIDE_NOTE)


def test_routes_and_round_robin(spark):
    df = spark.createDataFrame([(i, m) for i, m in enumerate(["gpt-4o", "LLAMA-3", "other", "gpt-x", "gpt-oss"])],
                               "id long, model string")
    def routes(available):
        return [r[0] for r in df.orderBy("id").select(judge.route_provider(F.col("model"), available)).collect()]
    assert routes(["OpenAI", "Groq"]) == ["OpenAI", "Groq", "OpenAI", "OpenAI", "OpenAI"]
    assert routes(["Groq"]) == [None, "Groq", None, None, "Groq"]
    open_ = df.select("id", judge.route_provider(F.col("model"), ["Groq"]).alias("p"))
    turns = judge.assign_round_robin(open_, "p", "id", {"Groq": 2, "Other": 1}).orderBy("id").collect()
    assert [(r.p, r.key_index) for r in turns] == [
        ("Groq", 0), ("Groq", 0), ("Groq", 1), ("Other", 0), ("Groq", 1)]
    lone = spark.createDataFrame([(i, None) for i in range(5)], "id long, p string")
    assert scan.row_position(lone, ["p"], "id", "n", 2).filter("n >= 1").count() == 5
    many = spark.range(20).select("id", F.lit("P").alias("p"))
    got = [r[0] for r in judge.assign_round_robin(many, "p", "id", {"P": 3}, block_rows=4).orderBy("id").select("key_index").collect()]
    assert got == [i % 3 for i in range(20)]


def test_prompts(spark):
    rows = [("h", "T", "P", 3.0, "5%", 1), ("h", "", "P", 3.0, None, 0), ("h", None, "", 3.5, "", 0)]
    df = spark.createDataFrame(rows, "hyp_transcript string, gt_timestamped string, gt_plain string, "
                                     "duration double, existing_cer string, existing_rf int")
    got = judge.build_prompts(df).collect()
    assert [r["reference_kind"] for r in got] == ["timed", "plain", "none"]
    assert "CER: 5%\nRepetition factor: 1" in got[0]["user"] and "Known" not in got[1]["user"]
    assert got[2]["user"].endswith("3.5s") and "3.0" not in got[1]["user"]


def test_checks(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    rules = {"small": F.col("x") < 2, "any": F.lit(True)}
    assert sorted(rows_of(checks.violations(df, rules))) == [("any", 3, 0), ("small", 3, 2)]
    checks.expect(df, {"any": F.lit(True)})
    with pytest.raises(checks.ExpectationFailed, match="small: 2"):
        checks.expect(df, rules)
    checks.expect_report("a b", required=["a"], banned=["z"])
    with pytest.raises(checks.ExpectationFailed):
        checks.expect_report("a b", banned=["b"])
    with pytest.raises(checks.ExpectationFailed):
        checks.expect_report("a b", required=["c"])


def test_stem_agreement(values):
    assert values("a string, b string", [("A (1).mp3", "a_(1).txt")],
                  canonical_stem(F.col("a")) == canonical_stem(F.col("b"))) == [(True,)]


def test_round_exact_rounds_like_correct_decimal_rounding(spark):
    rng = random.Random(8)
    values = [0.0625, 1 / 32, 0.5, 1.5, 2.5, 0.0005, 0.0015, 0.0025, 0.0045, 0.1245, 2.675, 1.005, 0.0, -0.0625, -2.675]
    values += [rng.random() * 10 ** rng.randint(-3, 6) for _ in range(2000)]
    values += [(rng.randint(0, 10**6) + 0.5) / 1000 for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = rows_of(df.select("v", *[text.round_exact(F.col("v"), d) for d in (2, 3, 4)],
                            *[text.fixed_text(F.col("v"), d) for d in (1, 2)],
                            text.fixed_text(F.col("v"), 3, sign=True)))
    for v, *found in got:
        assert found == [round(v, 2), round(v, 3), round(v, 4), f"{v:.1f}", f"{v:.2f}", f"{v:+.3f}"]


def test_no_bin_holds_a_key(spark):
    rng = random.Random(6)
    rows = [("day", 1.7e15 + rng.random() * 8.64e10) for _ in range(3000)]
    rows += [("tiny", rng.random() * 1e-7) for _ in range(3000)]
    rows += [("noise", 5.0 + rng.gauss(0, 1e-6)) for _ in range(3000)]
    rows += [(None, float(v)) for v in rng.choices(range(50), k=500)] + [("same", 2.5)] * 400
    df = spark.createDataFrame(rows, "key string, v double")
    binned = scan.fine_bins(df, ["key"], "v", bin_rows=50)
    assert binned.count() == len(rows)
    sizes = binned.groupBy("key", "_bin").agg(F.countDistinct("v").alias("n")).groupBy("key").agg(F.max("n"))
    assert all(n <= 50 for _, n in rows_of(sizes))
    order = binned.orderBy("key", "_bin", "v").select("key", "v").collect()
    assert order == df.orderBy("key", "v").collect()
    got = {r[0]: r[1:] for r in rows_of(quantiles.exact_quantiles(df, ["key"], "v", {"a": 0.5, "b": 0.95}))}
    for key in {k for k, _ in rows}:
        values = [v for k, v in rows if k == key]
        assert got[key] == pytest.approx((np.quantile(values, 0.5), np.quantile(values, 0.95)), rel=1e-12)

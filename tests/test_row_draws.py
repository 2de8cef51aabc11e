"""Intervals of queries whose every row is drawn for, against draws made one by one."""

from datetime import datetime
from random import Random
from statistics import quantiles

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from uttermark.operators import bootstrap
from uttermark.operators.superiority import superiority


def weights(row, seed):
    """The weights of a row in all replicates."""
    p = bootstrap.PRIME
    steps = [int(s * p) for s in bootstrap.POISSON_STEPS]
    for rep in range(bootstrap.REPLICAS):
        d = (((rep + 1) * 1000003 + seed * 7919) % p * 48271 + row % p * 69621 + 11) % p
        d = pow((pow(d, 5, p) + row % p * 16807 + 101) % p, 5, p)
        yield sum(d >= s for s in steps)


def interval(found):
    cuts = quantiles(found, n=40, method="inclusive")
    return pytest.approx((cuts[0], cuts[-1]), abs=2e-6)


def mean_interval(rows, seed):
    drawn = zip(*[[(w, v) for w in weights(row, seed)] for row, v in rows])
    return interval([sum(w * v for w, v in r) / sum(w for w, _ in r) for r in drawn if any(w for w, _ in r)])


def events(spark, root, n=120):
    """Two engines, two files, few distinct values."""
    rows = [(i, datetime(2024, 1, 1 + i % 3), i % 2, ("click", "view")[i // 2 % 2], (i % 3) * 1.5, '{"k": 45}')
            for i in range(n)]
    spark.createDataFrame(
        rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    ).write.parquet(f"{root}/events.parquet")
    return rows


def test_metric_summary_draws_for_every_row(spark, tmp_path):
    rows = events(spark, tmp_path)
    got = {(r.engine, r.metric): (r.ci_low, r.ci_high)
           for r in entry.queries()["metric_summary"](spark, str(tmp_path)).collect()}
    for engine in ("click", "view"):
        own = [(r[0], r[4]) for r in rows if r[3] == engine]
        assert got[engine, "cer_all"] == mean_interval(own, 101)


def test_order_lines_draw_for_every_row(spark, tmp_path):
    rows = [(i, i % 7, f"{'AR'[i % 2]}", i % 3) for i in range(120)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_returnflag string, n int").selectExpr(
        "l_orderkey", "l_linenumber", "l_returnflag", "double(n) AS l_quantity", "0.01D AS l_discount",
        "0.0D AS l_tax", "1L AS l_suppkey", "date'2024-01-01' AS l_shipdate", "'F' AS l_linestatus",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.engine: (r.ci_low, r.ci_high)
           for r in entry.queries()["bootstrap_order_lines"](spark, str(tmp_path)).collect()}
    for engine in "AR":
        own = [(r[0] * 8 + r[1], 1000 + r[3]) for r in rows if r[2] == engine]
        assert got[engine] == mean_interval(own, 11)


def superiority_interval(rows, seed):
    """Of P(right < left), out of (side, row, value)."""
    found = []
    drawn = [list(weights(row, seed)) for _, row, _ in rows]
    for rep in range(bootstrap.REPLICAS):
        left, right = ([(v, w[rep]) for (s, _, v), w in zip(rows, drawn) if s == side] for side in ("click", "view"))
        pairs = sum(w for _, w in left) * sum(w for _, w in right)
        if pairs:
            found.append(sum(a * b for v, a in left for u, b in right if u < v) / pairs)
    cuts = quantiles(found, n=40, method="inclusive")
    return pytest.approx((cuts[0], cuts[-1]), abs=1e-10)


def test_superiority_by_file_draws_for_every_row(spark, tmp_path):
    rows = events(spark, tmp_path)
    got = {r.file: (r.ci_low, r.ci_high)
           for r in entry.queries()["bootstrap_superiority_by_file"](spark, str(tmp_path)).collect()}
    for user, file in ((0, "silence_0.wav"), (1, "White_Noise_1.flac")):
        assert got[file] == superiority_interval([(r[3], r[0], r[4]) for r in rows if r[2] == user], 900)


@pytest.mark.parametrize("part_rows", [20, 1000])
def test_rows_of_large_keys_compare_as_plain_resampling(spark, part_rows):
    """NULL and negative row numbers, NULL keys, NaN and equal values included."""
    rng = Random(1)
    rows = [(rng.choice("ab") if i % 5 else None, rng.choice("LR"), i - 20 if i % 50 else None,
             rng.choice([float("nan"), 1.0, 2.0, rng.gauss(5, 3)])) for i in range(400)]
    df = spark.createDataFrame(rows, "key string, side string, id long, v double")
    side = F.col("side") == "L"
    draws = bootstrap.resample(df, ["key", "side"], "v", "id", seed=5, replicas=50, method="rows")
    each = superiority(draws, ["key", "rep"], "value", left=F.when(side, F.col("weight")).otherwise(0),
                       right=F.when(side, 0).otherwise(F.col("weight")))
    want = each.groupBy("key").agg(F.percentile("p_right", 0.025), F.percentile("p_right", 0.975))
    got = bootstrap._superiority_of_rows(df, ["key"], "v", "id", side, 5, 50, part_rows)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}

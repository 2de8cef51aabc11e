import pytest
from pyspark.sql import functions as F

from uttermark.functions import grading as g, signal as s
from uttermark.operators import rollup


def test_grade_bounds(values):
    rows = [
        (0.0, 0.0099, 0.099), (0.0, 0.01, 0.05), (0.4, 0.0, 0.05), (0.0, 0.0299, 0.199),
        (0.0, 0.03, 0.1), (0.5, 0.0, 0.0), (1.9, 0.0999, 0.499), (2.0, 0.0, 0.0), (0.0, 0.1, 0.0),
        (0.0, 0.0, 0.5), (0.0, 0.0, 0.2), (0.0, 0.0, 0.1),
    ]
    got = [r[0][0] for r in values("h double, c double, r double", rows,
                                   g.quality_grade(F.col("h"), F.col("c"), F.col("r")))]
    assert got == list("SAAABBBFFFBA")


def test_tiers(values):
    rows = [(None,), (20.0,), (20.01,), (50.0,), (50.01,)]
    got = [r[0] for r in values("c double", rows, g.quality_tier(F.col("c")))]
    assert got == ["unknown", "good", "fair", "fair", "poor"]


def test_row_grades(values):
    rows = [
        ("failed", "a", "x", "x"), ("success", "a", "", "x"), ("success", "a", "", ""),
        ("success", "a", "x", None), ("success", "Silence.wav", "x", "x"), (None, "b", "x", "x"),
    ]
    c = F.col
    grade = g.row_grade(c("s"), c("f"), c("h"), c("r"), F.lit(0.0), F.lit(3.0), F.lit(0.05), F.lit(0))
    got = [r[0] for r in values("s string, f string, h string, r string", rows, grade)]
    assert got == ["ERROR", "F (Fail)", "S (Excellent)", "A", "F (Fail)", "S (Excellent)"]


def test_media_names(values):
    rows = [("x/a.MP3",), ("a.wav.txt",), ("dir.flac/a",), ("b.m4a",), (".mp3",)]
    assert [r[0] for r in values("p string", rows, g.is_media(F.col("p")))] == [
        True, False, False, True, False,
    ]


def test_ratio_and_reasons(values):
    rows = [(1.0, 0.0), (1.0, 3.0)]
    assert [r[0] for r in values("t double, d double", rows, g.ratio(F.col("t"), F.col("d")))] == [
        0.0, 0.333,
    ]
    c = F.col
    rows = [(0.009, 0.0, 0.16, 5000.0), (0.01, 0.1, 0.15, 4000.0), (0.5, 0.2, 0.0, 10.0)]
    got = values("a double, b double, c double, d double", rows,
                 g.audio_reasons(c("a"), c("b"), c("c"), c("d")))
    assert [r[0] for r in got] == [
        [g.REASON_QUIET, g.REASON_NOISY], [], [g.REASON_NOISY, g.REASON_NARROW],
    ]


def test_silence_rate(spark):
    rows = [
        ("x_silence.mp3", "twelve chars", 90.0), ("talk.mp3", "does not count", 45.0),
        ("White_Noise.wav", "8 chars.", 150.0), ("silence_2.wav", None, None),
    ]
    df = spark.createDataFrame(rows, "file string, transcript string, duration double")
    assert rollup.silence_rate(df, []).first()["hrs"] == pytest.approx(20 / 4)
    assert rollup.silence_rate(df.filter("file = 'talk.mp3'"), []).first()["hrs"] == 0.0


@pytest.mark.parametrize("k,n,low,high", [(0, 0, None, None), (0, 10, 0.0, None), (10, 10, None, 1.0),
                                          (118, 165, 0.642, 0.779)])
def test_wilson(values, k, n, low, high):
    got = values("k long, n long", [(k, n)], rollup.wilson_low(F.col("k"), F.col("n")),
                 rollup.wilson_high(F.col("k"), F.col("n")))[0]
    if n == 0:
        assert got == (None, None)
        return
    assert 0 <= got[0] <= k / n <= got[1] <= 1
    if low is not None:
        assert got[0] == pytest.approx(low, abs=6e-4)
    if high is not None:
        assert got[1] == pytest.approx(high, abs=6e-4)


def test_signal_helpers(values):
    rows = [([0.5, -0.5, 1.0, -1.0, 0.25],), ([],)]
    x = F.col("x").cast("array<float>")
    got = values("x array<double>", rows, s.chunks(x, 2), s.to_int16(x), s.frame_rms(x),
                 s.zero_crossing_rate(x))
    assert got[0][0] == [[0.5, -0.5], [1.0, -1.0], [0.25]]
    assert got[0][1] == [16383, -16383, 32767, -32767, 8191]
    assert got[0][3] == pytest.approx(4 / 5)
    assert got[0][2] == pytest.approx((2.5625 / 5) ** 0.5)
    assert got[1][0] == []
    back = values("x array<double>", rows[:1], s.to_float(s.to_int16(x)))[0][0]
    assert back == pytest.approx(rows[0][0], abs=1e-4)

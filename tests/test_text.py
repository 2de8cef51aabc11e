import random
import re
import time
import unicodedata
from pathlib import PurePosixPath

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from uttermark.functions import text as t

DELETED = set("、。！？（）…「」,. :;[]{}()'\"")


def plain_normalize(s):
    kept = [c for c in s or "" if c not in DELETED and not c.isspace()]
    return "".join(
        chr(ord(c) - 0xFEE0) if 0xFF01 <= ord(c) <= 0xFF5E else c for c in kept
    ).lower()


def plain_cer(hyp, ref):
    if not ref:
        return 1.0 if hyp else 0.0
    row = list(range(len(ref) + 1))
    for i, h in enumerate(hyp, 1):
        diagonal, row[0] = row[0], i
        for j, r in enumerate(ref, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (h != r))
    return row[-1] / len(ref)


def plain_rf(s, n):
    grams = [s[i : i + n] for i in range(len(s) - n + 1)]
    found, streak = 0, 1
    for a, b in zip(grams, grams[1:] + [None]):
        if a == b:
            streak += 1
        else:
            found, streak = found + (streak >= 3), 1
    return found


def plain_stem(name):
    stem = PurePosixPath(name).name
    head, dot, _ = stem.rpartition(".")
    stem = head if dot and head else stem
    return re.sub("[^a-z0-9]+", "_", stem.lower()).strip("_")


ALPHABET = "aab ,.!?(Ａｂ，！？　\xa0\x1c é😀日。「」\n'\"[]{}:;\\-^"


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=30), min_size=200, max_size=300))
def test_normalize_and_rf_match_a_plain_restatement(spark, texts):
    df = spark.createDataFrame([(x,) for x in texts], "s string")
    got = df.select(
        "s", t.normalize_text(F.col("s")),
        t.repetition_factor(F.col("s")), t.repetition_factor(F.col("s"), 2),
    ).collect()
    for s, norm, rf3, rf2 in got:
        assert norm == plain_normalize(s)
        assert (rf3, rf2) == (plain_rf(s, 3) if len(s) >= 3 else 0, plain_rf(s, 2) if len(s) >= 2 else 0)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.text("aあé ", max_size=12), st.text("abあé", max_size=12)),
                min_size=100, max_size=200))
def test_cer_matches_a_plain_restatement(spark, pairs):
    df = spark.createDataFrame(pairs, "h string, r string")
    for h, r, cer in df.select("h", "r", t.char_error_rate(F.col("h"), F.col("r"))).collect():
        assert cer == plain_cer(h, r)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text("aB.é _-(1)/", min_size=1, max_size=15), min_size=100, max_size=200))
def test_stems_match_a_plain_restatement(spark, names):
    df = spark.createDataFrame([(x,) for x in names], "n string")
    for n, stem in df.select("n", t.canonical_stem(F.col("n"))).collect():
        assert stem == plain_stem(n), n


def test_normalize_edges(values):
    rows = [("a!b?",), ("ＡＢ１，",), ("a　b\xa0c",), (None,), ("",), ("（x）！",)]
    got = [r[0] for r in values("s string", rows, t.normalize_text(F.col("s")))]
    assert got == ["a!b?", "ab1,", "abc", "", "", "x"]
    assert unicodedata.normalize("NFKC", "ＡＢ１") == "AB1"


def test_canonical_stems(values):
    rows = [
        ("call_0007_42 (1).mp3",), ("call_0007_42_(1).txt",), ("Two Words (Draft).wav",),
        ("as_it_is",), ("--many--dashes--",), (".hidden",),
        ("a/b.c/D e.tar.gz",), ("",), (None,),
    ]
    got = [r[0] for r in values("n string", rows, t.canonical_stem(F.col("n")))]
    assert got == [
        "call_0007_42_1", "call_0007_42_1", "two_words_draft",
        "as_it_is", "many_dashes", "hidden", "d_e_tar", "", "",
    ]


def test_cer_edges(values):
    rows = [("", ""), ("x", ""), ("", "abc"), ("aaaaaaa", "b"), ("été", "ete")]
    got = [r[0] for r in values("h string, r string", rows,
                                t.char_error_rate(F.col("h"), F.col("r")))]
    assert got == [0.0, 1.0, 1.0, 7.0, 2 / 3]


def test_repetition_edges(values):
    rows = [("",), ("aa",), ("aaaa",), ("aaaaa",), ("aaaaabccccc",), ("abcabcabc",), (None,)]
    got = [r[0] for r in values("s string", rows, t.repetition_factor(F.col("s")))]
    assert got == [0, 0, 0, 1, 2, 0, 0]


def test_numbers(values):
    rows = [("65.49%",), ("65.49",), (" 7% ",), ("N/A",), ("",), ("1d",), ("N/A (Empty)",), (None,)]
    s = F.col("s")
    got = values("s string", rows, t.parse_percent(s), t.parse_cer(s), t.percent_text_basis_points(s))
    assert got[0] == (65.49, pytest.approx(0.6549), 6549)
    assert got[1] == (65.49, pytest.approx(0.6549), None)
    assert got[2][0] == 7.0
    assert [g[0] for g in got[3:]] == [None] * 5 and [g[2] for g in got[3:]] == [None] * 5


def test_run_key_orders_versions_as_numbers(spark):
    names = ["19-04-2026_v10", "19-04-2026_v2", "oddname", "01-05-2026_v1", "19-04-2025_v99"]
    df = spark.createDataFrame([(n,) for n in names], "r string")
    got = [r[0] for r in df.orderBy(t.run_key(F.col("r"))).collect()]
    assert got == ["oddname", "19-04-2025_v99", "19-04-2026_v2", "19-04-2026_v10", "01-05-2026_v1"]


def test_ngrams_excerpt_cells(values):
    rows = [("日本語a",), ("ab",), ("",)]
    assert [r[0] for r in values("s string", rows, t.char_ngrams(F.col("s")))] == [
        ["日本語", "本語a"], [], [],
    ]
    text = [("\n a \r\n\n b\nc\nd",)]
    assert values("s string", text, t.excerpt(F.col("s"))) == [("a b c",)]
    cells = [("a|b\nc",)]
    assert values("s string", cells, t.escape_cell(F.col("s"))) == [("a\\|b c",)]
    flags = [(True, "65.49%"), (False, "N/A")]
    assert values("h boolean, c string", flags, t.verdict_cell(F.col("h"), F.col("c"))) == [
        ("H (65.49%)",), ("OK (N/A)",),
    ]


def test_timed_lines(values):
    ref = "[1.349 - 3.4] SPEAKER 1: later words\nnoise\n[0.5 - 1.2] SPEAKER 2: first, words"
    got = values("s string", [(ref,)], t.parse_timed_lines(F.col("s")),
                 t.timed_text(t.parse_timed_lines(F.col("s"))))
    assert [tuple(x) for x in got[0][0]] == [
        ("1.349", "3.4", "SPEAKER 1", "later words"), ("0.5", "1.2", "SPEAKER 2", "first, words"),
    ]
    assert got[0][1] == "first, words later words"


def test_log_lines_round_trip(values):
    line = t.log_line(F.lit("10:11:12"), F.col("c"), F.lit("commit_received  bytes=12 total=3"))
    got = values("c string", [("ab12",)], t.parse_log_line(line))[0][0]
    assert (got.clock, got.conn, got.event, got.fields) == (
        "10:11:12", "ab12", "commit_received", {"bytes": "12", "total": "3"},
    )


def edited(rng, text, times):
    chars = list(text)
    for _ in range(times):
        at, kind = rng.randrange(len(chars)), rng.random()
        if kind < 0.4:
            chars[at] = rng.choice("xyé漢😀")
        elif kind < 0.7:
            chars.insert(at, rng.choice("xyé漢😀"))
        else:
            del chars[at]
    return "".join(chars)


def test_edit_distance_of_long_texts_equals_the_whole_matrix(values):
    rng = random.Random(1)
    rows = []
    for n in (1, 5, 255, 256, 257, 300, 700, 1500):
        for d in (0, 1, 3, 8, 30, 70, 300):
            a = "".join(rng.choice("abcé漢😀") for _ in range(n))
            rows.append((a, edited(rng, a, min(d, n // 2))))
    rows += [("", "x" * 400), ("x" * 400, ""), ("ab" * 300, "ab" * 310), ("a" * 300, "b" * 300),
             (None, "a"), ("a" * 300, None), (None, "a" * 300)]
    a, b = F.col("a"), F.col("b")
    assert all(x == y for x, y in values("a string, b string", rows, t.edit_distance(a, b), F.levenshtein(a, b)))


def test_edit_distance_of_very_long_texts_takes_no_matrix(values):
    rng = random.Random(2)
    a = "".join(rng.choice("abcdefgé漢😀") for _ in range(50_000))
    spots = sorted(rng.sample(range(0, 50_000, 50), 10), reverse=True)
    b = a
    for i, at in enumerate(spots):  # ten places far apart, of all three kinds
        b = b[:at] + ["", "#", "#" + b[at]][i % 3] + b[at + 1 :]
    started = time.time()
    got = values("a string, b string", [(a, b), (b, a), (a, a), (a, a[300:] + b[:7])],
                 t.edit_distance(F.col("a"), F.col("b")))
    assert [r[0] for r in got[:3]] == [10, 10, 0] and 290 <= got[3][0] <= 307
    assert time.time() - started < 30  # the matrix of one pair alone takes longer

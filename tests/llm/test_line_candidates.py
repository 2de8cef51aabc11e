"""Lines of one bucket that are not alike: how many pairs of them are compared."""

import random
import re

import brute
from pyspark.sql import functions as F
from uttermark.llm import lines

SCHEMA = "doc_id bigint, text string"


def shared_passage(n=250):
    """Lines that share half of their text and are otherwise made of few syllables, so
    that all of their shingles are frequent; some are copies with one word changed."""
    rng = random.Random(5)
    parts = ["the", "er", "on", "an", "in", "re", "he", "nd"]
    words = lambda k: ["".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(k)]
    passage = words(30)
    rows = [(d, " ".join(passage + words(25))) for d in range(n)]
    for d in range(n, n + 40):
        line = rows[rng.randrange(n)][1].split(" ")
        line[rng.randrange(len(line))] = "other"
        rows.append((d, " ".join(line)))
    return rows


def check(spark, monkeypatch):
    seen = []
    prefix_pairs = lines.prefix_pairs

    def counted(*args):
        out = prefix_pairs(*args)
        seen.append(out.count())
        return out

    monkeypatch.setattr(lines, "prefix_pairs", counted)
    rows = shared_passage()
    got = lines.dedup_lines(spark.createDataFrame(rows, SCHEMA))
    assert {r.doc_id: r.text for r in got.collect()} == brute.dedup_lines(rows)
    return sum(seen), len(rows)


def test_pairs_follow_the_lines_not_their_square(spark, monkeypatch):
    pairs, n = check(spark, monkeypatch)
    assert pairs <= n


def test_large_buckets_by_prefixes(spark, monkeypatch):
    monkeypatch.setattr(lines, "SMALL", 0, raising=False)
    pairs, n = check(spark, monkeypatch)
    assert pairs <= 4 * n


def test_sketches_lose_no_link(spark):
    rng = random.Random(6)
    letters = "abcde "
    rows = []
    for i in range(150):
        a = "".join(rng.choices(letters, k=rng.randint(5, 900)))
        at = rng.randrange(len(a))
        rows.append((2 * i, a))
        rows.append((2 * i + 1, a[:at] + "xyz" * rng.randint(0, 2) + a[at + rng.randint(0, 3) :]))
    texts = spark.createDataFrame(rows, "node bigint, line string")
    found = {r.node: r for r in lines._sketches(texts, 5).collect()}
    for i in range(150):
        a, b = (
            {t[j : j + 5] for j in range(max(len(t) - 4, 1))} for t in (rows[2 * i][1], rows[2 * i + 1][1])
        )
        x, y = found[2 * i], found[2 * i + 1]
        assert (x.size, y.size) == (len(a), len(b))
        differ = sum(((p ^ q) & (2**64 - 1)).bit_count() for p, q in zip(x.sketch, y.sketch))
        assert differ <= len(a ^ b)


def test_signed_shingles_are_the_same(spark):
    """As with a look at every position: words' starts and runs from the ninth sign on."""
    rng = random.Random(7)
    texts = ["".join(rng.choices("ab漢😀 \t", k=rng.randint(1, 60))) for _ in range(300)]
    texts += ["x" * 8, "x" * 9, "x" * 30, "\ta b", "12345678 9", "123456789 0"]
    rows = spark.createDataFrame([(t,) for t in texts], "line string")
    got = rows.select("line", F.regexp_extract_all("line", F.lit(lines.SIGNED), F.lit(1)).alias("s"))
    every = re.compile(r"(?s)(?:(?<!\S)|(?<=\S{8}))(?=(\S.{0,7}))")
    assert all(r.s == every.findall(r.line) for r in got.collect())

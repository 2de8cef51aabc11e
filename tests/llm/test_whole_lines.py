"""Lines compared at every position."""

import random

import brute
from uttermark.llm.lines import dedup_lines

SCHEMA = "doc_id bigint, text string"
ALIKE = [
    "https://www.a.com/x", "https://www.b.org/entirely/other",
    '{"id":123456,"a":1}', '{"id":123456,"b":"other"}',
    "今天的天气非常好我们一起去公园散步吧", "今天的天气非常好我们一起去海边看日落和渔船",
    "abc", "abd", "😀😀😀😀😀😁", "😀😀😀😀😀😂😃",
]


def test_lines_that_only_start_alike_stay(spark):
    docs = spark.createDataFrame(list(enumerate(ALIKE)), SCHEMA)
    got = dedup_lines(docs)
    assert {r.doc_id: r.text for r in got.collect()} == dict(enumerate(ALIKE))


def test_long_runs_that_differ_at_their_start_are_linked(spark):
    run = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz漢字", k=300))
    docs = spark.createDataFrame([(1, run), (2, "#" + run[1:]), (3, run[3:] + "end")], SCHEMA)
    assert {r.doc_id: r.text for r in dedup_lines(docs).collect()} == {1: run, 2: "", 3: ""}


def test_whole_lines_equal_brute_force(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(200)]
    base = [rng.choices(words, k=rng.randint(12, 40)) for _ in range(30)]
    rows = list(enumerate(ALIKE))
    for d in range(100, 160):
        line = list(rng.choice(base))
        line[rng.randrange(len(line))] = rng.choice(words)
        rows.append((d, " ".join(line)))
    got = dedup_lines(spark.createDataFrame(rows, SCHEMA))
    assert {r.doc_id: r.text for r in got.collect()} == brute.dedup_lines(rows)

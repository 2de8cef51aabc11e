"""How often lines are taken apart, and where whole texts travel."""

import random

from uttermark.llm import lines
from uttermark.llm.common import BROADCAST_ROWS

SCHEMA = "doc_id bigint, text string"


def test_sets_are_worked_out_once(spark):
    """Of a plain explode, Spark infers a filter that works out every set again."""
    texts = spark.createDataFrame([(1, "some line")], "node bigint, line string")
    plan = lines._sketches(texts, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct" in plan and "Filter" not in plan


def test_only_bytes_bound_the_broadcast_of_removed_lines(spark, monkeypatch):
    """Else the texts of all documents go through a shuffle from some row count on."""
    bounds = []
    broadcast_if_small = lines.broadcast_if_small

    def seen(df, *args, **named):
        bounds.append((args[0] if args else named.get("rows", BROADCAST_ROWS), "size" in named or len(args) > 1))
        return broadcast_if_small(df, *args, **named)

    monkeypatch.setattr(lines, "broadcast_if_small", seen)
    docs = spark.createDataFrame([(1, "a line\nanother"), (2, "a line\nother")], SCHEMA)
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()}
    assert got == {1: "a line\nanother", 2: "other"}
    assert bounds[-1] == (BROADCAST_ROWS, True) and all(n >= BROADCAST_ROWS for n, _ in bounds)


def test_shingles_are_those_of_a_walk(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choices("ab漢😀é \t", k=rng.randint(1, 40))) for _ in range(200)]
    texts += ["", "abcd", "abcde", "😀😀😀😀", "x" * 3000]
    rows = spark.createDataFrame(list(enumerate(texts)), "node bigint, line string")
    got = {r.node: r.h for r in rows.select("node", lines._shingles(rows.line, 5).alias("h")).collect()}
    names = {}
    for i, t in enumerate(texts):
        walk = [t[j : j + 5] for j in range(max(len(t) - 4, 1))]
        assert len(got[i]) == len(walk)
        assert all(names.setdefault(s, h) == h for s, h in zip(walk, got[i]))
    assert len(set(names.values())) == len(names)


def test_places_are_those_of_lines_that_may_go(spark, monkeypatch):
    """Lines that occur once and are linked to none stay without being looked up."""
    rows = {}
    written = lines.written

    def counted(df, label):
        out = written(df, label)
        rows[label] = out.count()
        return out

    monkeypatch.setattr(lines, "written", counted)
    near = "a rather long line of many words that two documents have in nearly equal form"
    texts = ["only here\nboth", "both\nnor here", near + "\n ", near + "s\nlast of all", "both"]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    got = {r.doc_id: (r.text, r.n_removed) for r in lines.dedup_lines(docs).collect()}
    assert got == {
        0: (texts[0], 0), 1: ("nor here", 1), 2: (texts[2], 0), 3: ("last of all", 1), 4: ("", 1)
    }
    assert rows["places"] == 5


def test_shingles_share_rows_of_sketches(spark):
    """Each row renews all words of a sketch, so there are fewer rows than shingles."""
    line = "".join(random.Random(9).choices("abcdefgh ", k=8 * 50 + 4))
    texts = spark.createDataFrame([(1, line), (2, "abc")], "node bigint, line string")
    found = lines._sketches(texts, 5)
    sets = {r.node: r for r in found.collect()}
    assert sets[1].size == len({line[i : i + 5] for i in range(400)}) and sets[2].size == 1
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(sequence(" in plan

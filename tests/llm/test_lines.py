import random

import brute
from uttermark.llm.lines import dedup_lines

SCHEMA = "doc_id bigint, text string"


def test_equals_brute_force(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(300)]
    line = lambda k: " ".join(rng.choices(words, k=k))
    pool = [line(rng.randint(1, 40)) for _ in range(40)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randint(0, 8)):
            kind = rng.random()
            base = rng.choice(pool).split(" ")
            if kind < 0.4:
                base[rng.randrange(len(base))] = rng.choice(words)
            lines.append(line(20) if kind > 0.7 else " ".join(base).upper() if kind < 0.1 else " ".join(base))
        rows.append((d, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n \n\n"), (103, pool[0]), (104, "x" * 50000), (105, "x" * 50000)]
    got = dedup_lines(spark.createDataFrame(rows, SCHEMA))
    assert {r.doc_id: r.text for r in got.collect()} == brute.dedup_lines(rows)


def test_extra_columns_repeats_and_empty_tables(spark):
    rows = [(1, "a b\nc d", 9), (1, "a b\nc d", 9), (2, "c d\ne f", 8), (None, "e f\n", 7)]
    docs = spark.createDataFrame(rows, SCHEMA + ", n_lines int")
    got = dedup_lines(docs)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(
        [(1, "a b\nc d", 2, 0), (1, "a b\nc d", 2, 0), (2, "e f", 2, 1), (None, "", 2, 1)], key=repr
    )
    assert dedup_lines(docs.limit(0)).count() == 0


def test_plan_has_no_python(spark):
    docs = spark.createDataFrame([(1, "a b")], SCHEMA)
    plan = dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

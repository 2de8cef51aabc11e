import random

import numpy as np
from hypothesis import given, settings, strategies as st

import brute
from uttermark.llm.common import components
from uttermark.llm.minhash import MinMax, WordHashes, band_count, near_duplicates, shingle_set
from uttermark.llm.minhash import without_near_duplicates

SCHEMA = "doc_id bigint, text string"


def corpus(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    base = [rng.choices(words, k=80) for _ in range(6)]
    for text in base:
        for edits in [0, 0, 1, 2, 3, 5, 8, 13, 21]:
            copy = list(text)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((n, " ".join(copy)))
            n += 1
    shared = " ".join(rng.choices(words, k=60))
    rows += [(n + i, shared + " " + " ".join(rng.choices(words, k=12))) for i in range(25)]
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "One"), (204, "one"), (205, "one two"),
             (206, "ONE\x0btwo"), (207, "é É"), (208, "é é"), (209, "x " * 20000)]
    return rows


def test_equals_brute_force_on_hard_groups(spark):
    rows = corpus()
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), 3, 85, 100).collect()
    want = brute.near_duplicates(rows, 3, 85, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_nulls_repeats_extra_columns_and_empty_tables(spark):
    rows = [(1, "a b c d", 0), (1, "a b c d", 0), (2, "A B C D", 1), (None, "a b c d", 2), (3, None, 3)]
    docs = spark.createDataFrame(rows, SCHEMA + ", kept int")
    got = sorted(map(tuple, near_duplicates(docs, 3, 85, 100).collect()), key=repr)
    assert got == sorted(
        [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, None, True), (3, 0, 3, True)],
        key=repr,
    )
    left = without_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(map(tuple, left.collect()), key=repr) == sorted(
        [(1, "a b c d", 0), (None, "a b c d", 2), (3, None, 3)], key=repr
    )
    assert near_duplicates(docs.limit(0), 3, 85, 100).count() == 0


@given(st.lists(st.text("ab \t\n", max_size=12), max_size=12))
@settings(max_examples=60, deadline=None)
def test_shingle_sets_have_the_size_of_the_exact_ones(texts):
    cache = WordHashes()
    for t in texts:
        assert len(shingle_set(t.encode(), 3, cache)) == len(brute.shingles(t, 3))


def test_signature_estimates_similarity_and_bands_rarely_miss():
    assert (1 - (0.85**7)) ** band_count(0.85) <= 1e-5
    rng, sign = np.random.default_rng(1), MinMax(60)
    a = rng.integers(0, 2**64, 1000, dtype=np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**64, 200, dtype=np.uint64)])
    x, y = (np.frombuffer(sign(np.sort(s))[1], np.uint8) for s in (a, b))
    assert abs((x == y).mean() - 800 / 1200) < 0.09


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, 501 + i) for i in range(40)]
    loose = [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)]
    edges = chain[::-1] + star + loose + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {n: c for n, c in brute.components(nodes, [e for e in edges if e[0] != e[1]]).items()}

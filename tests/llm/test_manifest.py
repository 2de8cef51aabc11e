import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F
from uttermark.llm.manifest import fold, grow, manifest, siblings

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def digest(text):
    return sha256(text.encode()).hexdigest()


def leaf(row):
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row]
    return digest("".join(parts))


def up(nodes):
    """All rows of a tree, each parent hashed from the texts of its children."""
    rows = [nodes]
    while len(rows[-1]) > 1:
        rows.append([digest("".join(rows[-1][i : i + 3])) for i in range(0, len(rows[-1]), 3)])
    return rows


def path(rows, place):
    for below in rows[:-1]:
        start = place // 3 * 3
        yield below[start : start + 3], place - start
        place //= 3


def brute(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees, own = {}, {}
    for s in sources:
        own[s] = sorted(
            (r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))
        )
        trees[s] = up([leaf(r) for r in own[s]])
    upper = up([trees[s][-1][0] for s in sources])
    out = []
    for at, s in enumerate(sources):
        for i, r in enumerate(own[s]):
            steps = list(path(trees[s], i)) + list(path(upper, at))
            proof = "".join(x for run, k in steps for j, x in enumerate(run) if j != k)
            text = r[4]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            now = leaf((*r[:4], text))
            for run, k in steps:
                now = digest("".join(now if j == k else x for j, x in enumerate(run)))
            root = upper[-1][0]
            out.append((r[0], leaf(r), trees[s][-1][0], root, digest(proof), now, now == root))
    return out


def rows_of_all_kinds():
    rows = [(i, "hot", "en", i, f"text {i}\nmore") for i in range(130)]
    rows += [(i, f"s{i % 11}", "de", None, None if i % 7 == 0 else "x\n" * (i % 4)) for i in range(200, 260)]
    rows += [(300, None, None, None, ""), (301, "Ω", "zh", 3, "日本\n語"), (302, "one", "en", 1, "a\nb" * 50_000)]
    # Repeated ids and rows, and rows without an id.
    rows += [(5, "hot", "en", 5, "text 5\nmore"), (5, "hot", "fr", 5, "other"), (None, "hot", "en", 1, "no\nid")]
    return rows


def run(spark, rows, levels, schema=SCHEMA):
    docs = spark.createDataFrame(rows, schema)
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    return manifest(docs, even, F.translate("text", "\n", ""), levels)


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_equals_brute_force_whatever_the_size_of_a_subtree(spark, levels):
    rows = rows_of_all_kinds()
    got = [tuple(r) for r in run(spark, rows, levels).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    assert {r[6] for r in got} == {True, False}


def test_small_and_empty_tables_and_clashing_columns(spark):
    alone = [(1, "s", "en", 1, "no line end")]
    got = run(spark, alone, 7).collect()
    assert [tuple(r) for r in got] == brute(alone)
    assert got[0].root == got[0].leaf and got[0].proof_sha256 == digest("")
    wide = [r + ("x", "y") for r in rows_of_all_kinds()[:20]]
    got = run(spark, wide, 1, SCHEMA + ", root string, key string")
    assert sorted(map(tuple, got.collect())) == sorted(brute([r[:5] for r in wide]))
    empty = run(spark, [], 7)
    assert empty.count() == 0 and empty.columns[0] == "doc_id"


def test_folding_resumes_the_state_before_the_slot():
    leaves = [digest(str(i)).encode() for i in range(20)]
    rows, states = grow(leaves, None)
    new = digest("new").encode()
    for place in range(20):
        changed = [new if i == place else x for i, x in enumerate(leaves)]
        sides = siblings(rows, place)
        # What stands on the left is in the states alone.
        blind = [(b"", right) for _, right in sides]
        assert fold(new, place, states, blind) == grow(changed, None)[0][-1][0]
        assert fold(leaves[place], place, states, blind) == rows[-1][0]

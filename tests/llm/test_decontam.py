import hashlib
import random

import brute
from uttermark.llm.decontam import contamination, without_contaminated

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"


def check(spark, docs, items):
    got = contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    want = brute.contamination(docs, items)
    for r in got:
        n, hit, ids = want[r.doc_id]
        sha = hashlib.sha256(",".join(ids).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (
            n, hit, len(ids), sha, hit > 0,
        )
    assert len(got) == len(docs)


def test_equals_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(50)] + ["É", "x9"]
    text = lambda n: " ".join(rng.choices(words, k=n))
    items = [(i, text(rng.randint(10, 40))) for i in range(12)]
    items += [(20, "a b"), (21, "lone"), (22, None), (23, "--"), (24, items[0][1]), (None, items[1][1])]
    docs = []
    for d in range(40):
        w = text(rng.randint(0, 60)).split(" ")
        src = rng.choice(items[:12])[1].split(" ")
        cut = src[rng.randrange(3) :][: rng.randint(8, 14)]
        docs.append((d, ", ".join(w[:10] + cut + w[10:]).upper() if d % 2 else " ".join(w)))
    docs += [(50, None), (51, ""), (52, "a B"), (53, "q lone q"), (54, items[2][1] * 300), (55, "a " * 30)]
    check(spark, docs, items)


def test_empty_benchmark_repeats_and_extra_columns(spark):
    docs = [(1, "one two three four five six seven eight nine ten eleven", "x")] * 2 + [
        (2, "clean", "y"), (None, "one two three four five six seven eight nine ten", "z")]
    frame = spark.createDataFrame(docs, DOCS + ", words string")
    items = spark.createDataFrame([(1, "ONE TWO-three four five six seven eight nine ten")], ITEMS)
    left = without_contaminated(frame, items)
    assert left.columns == frame.columns and [tuple(r) for r in left.collect()] == [docs[2]]
    assert contamination(frame, items.limit(0)).filter("contaminated").count() == 0
    assert contamination(frame.limit(0), items).count() == 0

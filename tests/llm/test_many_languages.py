import random

from pyspark.sql import functions as F

from uttermark.llm.langid import FULL, identify, learn


def test_every_language_is_learned(spark):
    rng, rows, n = random.Random(5), [], FULL + 44
    for i in range(n):
        words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)]
        text = lambda: " ".join(rng.choices(words, k=40))
        rows += [(i, text(), f"l{i:03d}")] * (1 if i > FULL else 2) + [(1000 + i, text(), None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    known = learn(docs, F.lit(True))
    assert [name for name, _ in known][:2] == ["l000", "l001"] and len(known) == n
    assert all(data for _, data in known)
    asked = docs.filter("doc_id IN (1000, 1257, 1299)").drop("lang")
    got = {r.doc_id: r.lang_pred for r in identify(asked, known).collect()}
    assert got == {1000: "l000", 1257: "l257", 1299: "l299"}

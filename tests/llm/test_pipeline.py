import brute
import corpus_pipeline
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string"
ENGLISH = "the house of the old man and the sea is on the hill where the {} wind was blowing all the night"


def rows():
    texts = {
        1: ENGLISH.format("cold") + "\nshared line of some length for all of them",
        2: ENGLISH.format("cold"),
        3: "shared line of some length for all of them\nla casa de los niños que no tienen pan ni agua en la mañana",
        4: "one two three four five six seven eight nine ten eleven words of the benchmark",
        5: None, 6: "", 7: "1234 %%", 8: "the end of the story is near and all of the people are here",
    }
    out = [(d, t, "es" if d == 3 else "en", "s", len(t or ""), "x") for d, t in texts.items()]
    return [*out, out[0], (None, "an id is not the point of the story, it is the text", "en", "s", 51, "x")]


def test_stages_take_effect_in_order(spark, tmp_path):
    spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows(), SCHEMA)
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "lines", "near_duplicates", "decontaminate", "packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = sorted((r.doc_id for r in docs.collect()), key=str)
    assert seen["language"] == [1, 1, 2, 3, 4, 8, None]
    assert seen["lines"] == [1, 1, 3, 4, 8, None]
    assert seen["near_duplicates"] == [1, 3, 4, 8, None]
    assert seen["decontaminate"] == [1, 3, 8, None]
    assert seen["packing"] == [1, 3, 8, None]


def test_stages_equal_brute_force_on_given_documents(spark):
    root = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{root}/documents.parquet").filter("doc_id < 150")
    given = [(r.doc_id, r.text) for r in docs.collect()]
    lined = corpus_pipeline.lines(spark, docs, root)
    want = {d: t for d, t in brute.dedup_lines(given).items() if t.strip()}
    assert {r.doc_id: r.text for r in lined.collect()} == want
    assert lined.filter(F.col("n_chars") != F.char_length("text")).count() == 0
    kept = corpus_pipeline.near_duplicates(spark, docs, root)
    found = brute.near_duplicates(given, 5, 4, 5)
    assert {r.doc_id for r in kept.collect()} == {d for d, (_, c) in found.items() if d == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{root}/benchmark.parquet").collect()]
    clean = corpus_pipeline.decontaminate(spark, docs, root)
    hits = brute.contamination(given, items)
    assert {r.doc_id for r in clean.collect()} == {d for d, (_, n, _) in hits.items() if not n}


def test_empty_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "/root/testdata/sf0.001").count() == 0

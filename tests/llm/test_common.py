from pyspark.sql import functions as F

from uttermark.llm import common, lines, pii


def hinted(df):
    return "broadcast" in df._jdf.queryExecution().logical().toString()


def test_few_rows_of_long_arrays_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", 10_000)
    few = spark.range(3).select("id", F.sequence(F.lit(1), F.lit(2000)).alias("places"))
    size = 64 + 4 * F.size("places")
    assert not hinted(common.broadcast_if_small(few, 100, size))
    assert hinted(common.broadcast_if_small(few.limit(1), 100, size))
    assert not hinted(common.broadcast_if_small(few.limit(1), 0, size))
    assert hinted(common.broadcast_if_small(few.limit(0), 100, size))


def test_long_documents_give_the_same_without_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b\n" * 50 + "c@d.com"), (2, "a b\nc@d.com")], "doc_id bigint, text string")
    want = [sorted(map(tuple, f.collect())) for f in (lines.dedup_lines(docs), pii.with_surrogates(docs, "k"))]
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    left = lines.dedup_lines(docs), pii.with_surrogates(docs, "k")
    assert [sorted(map(tuple, f.collect())) for f in left] == want

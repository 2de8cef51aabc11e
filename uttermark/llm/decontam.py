"""Benchmark decontamination by winnowing, with DataFrame functions alone.

Of each run of six hashes of five-word grams the smallest is kept as a fingerprint, so a
document and an item that share ten words in a row share a fingerprint. Fingerprints of
documents that items have too are extended to all ten-word windows around them, and these
are compared word by word with the windows of the items.

Only fingerprints that an item has leave their document; documents move once more, and
only if the table of those that were hit is too large to broadcast. Tables on the items'
side are written first, so Spark knows their size and broadcasts them only if small.

Items of fewer than ten words are one window each, which no such fingerprint covers:
for the at most nine lengths that occur, documents give their grams of that length.

Defined cases: a null text has no words; a document without hits has no items and the
digest of the empty string. An item without words has no window; one without id marks
words, but counts as no item. Repeated documents are judged alike, repeated items and
windows count once. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import broadcast_if_small, table, written
from .registry import query

WINDOW = 10
GRAM = 5
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A fingerprint carries its word position in its low bits, more than a text can have words.
PLACE_BITS = 28


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def each(array: Column) -> Column:
    """A row for each element, and one with NULL for an empty array, which no join keeps.
    From a plain explode, Spark infers a filter on the array and pushes it down through
    the steps that build the array, which repeats them all within one another."""
    return F.explode_outer(array)


def _places(count: Column) -> Column:
    """0 .. count - 1, none where count is not positive."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(
        F.array().cast("array<int>")
    )


def with_fingerprints(df: DataFrame) -> DataFrame:
    """Add ``prints`` to a table with ``words``: gram hash above, word position below."""
    hashed = df.withColumn("_h", F.transform("words", lambda w: F.xxhash64(w)))
    keep = F.lit(-1 << PLACE_BITS)
    grams = hashed.withColumn(
        "_g",
        F.transform(
            _places(F.size("_h") - (GRAM - 1)),
            lambda i: F.xxhash64(*[F.col("_h")[i + j] for j in range(GRAM)])
            .bitwiseAND(keep)
            .bitwiseOR(i.cast("bigint")),
        ),
    )
    run = WINDOW - GRAM + 1
    return grams.withColumn(
        "prints",
        F.array_distinct(
            F.transform(
                _places(F.size("_g") - (run - 1)),
                lambda i: F.least(*[F.col("_g")[i + j] for j in range(run)]),
            )
        ),
    ).drop("_h", "_g")


def gram_at(start: Column, length: Column) -> Column:
    return F.array_join(F.slice(F.col("words"), start + 1, length), " ")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """What of ``docs`` (doc_id, text) occurs in ``items`` (item_id, text).

    Returns one row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated.
    """
    keys = ["k1", "k2"]
    keyed = docs.select(
        "doc_id",
        F.xxhash64(F.lit(1), "doc_id", "text").alias("k1"),
        F.xxhash64(F.lit(2), "text", "doc_id").alias("k2"),
        "text",
    )
    parsed = keyed.select("doc_id", *keys, words(F.col("text")).alias("words"))
    listed = written(
        items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("words")),
        "items",
    )
    size = F.least(F.size("words"), F.lit(WINDOW))
    windows = written(
        listed.withColumn("length", size)
        .filter("length > 0")
        .select("item", "length", "words", each(_places(F.size("words") - size + 1)).alias("start"))
        .select("item", "length", gram_at(F.col("start"), F.col("length")).alias("gram"))
        .filter("gram IS NOT NULL")
        .distinct(),
        "windows",
    )
    prints = written(
        with_fingerprints(listed)
        .select(each("prints").alias("print"))
        .select(F.shiftright("print", PLACE_BITS).alias("print"))
        .filter("print IS NOT NULL")
        .distinct(),
        "prints",
    )

    around = F.sequence(
        F.greatest(F.col("place") - (WINDOW - GRAM), F.lit(0)),
        F.least(F.col("place"), F.col("n") - WINDOW),
    )
    starts = [
        with_fingerprints(parsed)
        .select(*keys, F.size("words").alias("n"), each("prints").alias("_p"))
        .select(
            *keys,
            "n",
            F.shiftright("_p", PLACE_BITS).alias("print"),
            F.col("_p").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int").alias("place"),
        )
        .join(prints, "print", "left_semi")
        .select(*keys, F.lit(WINDOW).alias("length"), each(around).alias("start"))
    ]
    short = windows.filter(F.col("length") < WINDOW)
    for (length,) in short.select("length").distinct().orderBy("length").collect():
        grams = short.filter(F.col("length") == length).select(F.xxhash64("gram").alias("hash"))
        starts.append(
            parsed.select(*keys, "words", each(_places(F.size("words") - (length - 1))).alias("start"))
            .select(
                *keys,
                F.lit(length).alias("length"),
                "start",
                F.xxhash64(gram_at(F.col("start"), F.lit(length))).alias("hash"),
            )
            .join(grams.distinct(), "hash", "left_semi")
            .drop("hash")
        )
    union = starts[0]
    for more in starts[1:]:
        union = union.unionByName(more)
    suspects = written(
        union.groupBy(*keys).agg(F.collect_set(F.struct("start", "length")).alias("starts")),
        "suspects",
    )
    # First the documents that were hit, by their keys alone, then their windows.
    hit = keyed.join(broadcast_if_small(suspects.select(*keys)), keys, "left_semi")
    found = written(
        hit.select(*keys, "text")
        .join(suspects, keys)
        .withColumn("words", words(F.col("text")))
        .select(
            *keys,
            each(
                F.transform(
                    "starts",
                    lambda x: F.struct(
                        x["start"].alias("start"),
                        x["length"].alias("length"),
                        gram_at(x["start"], x["length"]).alias("gram"),
                    ),
                )
            ).alias("x"),
        )
        .select(*keys, "x.*")
        .join(windows, ["gram", "length"])
        .groupBy(*keys)
        .agg(
            F.collect_set(
                F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)
            ).alias("spans"),
            F.collect_set("item").alias("items"),
        )
        .select(
            *keys,
            F.size(F.array_distinct(F.flatten("spans"))).cast("bigint").alias("n_hit"),
            F.size("items").cast("bigint").alias("n_items"),
            F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ),
        "found",
    )
    none = F.lit(0).cast("bigint")
    return (
        parsed.select("doc_id", *keys, F.size("words").cast("bigint").alias("n_words"))
        .join(found, keys, "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", none).alias("n_hit"),
            F.coalesce("n_items", none).alias("n_items"),
            F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
            F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
        )
    )


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs, with all their columns."""
    keyed = docs.withColumns(
        {"_id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "_t": F.xxhash64("text")}
    )
    hit = (
        contamination(
            keyed.select(F.struct("_id", "_t").alias("doc_id"), "text"), items
        )
        .filter("contaminated")
        .select("doc_id._id", "doc_id._t")
        .distinct()
    )
    return keyed.join(hit, ["_id", "_t"], "left_anti").select(*docs.columns)


SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
v AS (
  SELECT item_id, list_filter(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
i AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM (
    SELECT item_id, w, least(len(w), 10) AS n,
      unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM v WHERE len(w) > 0)),
d AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s
    FROM w, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)),
h AS (SELECT doc_id, s, n, item_id FROM d JOIN i USING (n, g)),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY doc_id),
j AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(c, ',' ORDER BY c)) AS x
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS c FROM h) GROUP BY doc_id)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, coalesce(x, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN p USING (doc_id) LEFT JOIN j USING (doc_id)
"""


@query("op6_benchmark_decontamination", SQL)
def op6(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

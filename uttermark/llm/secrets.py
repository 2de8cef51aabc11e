"""Scanning for secrets, with a random forest that removes false positives.

Candidates are values of any length that stand in quotes behind an assignment, behind '='
or behind a name that speaks of secrets and a colon, and all runs of 16 or more letters,
digits and signs that keys are made of. Each is described by its length, its character transitions (changes of class, and how likely its
letter pairs are in the corpus), the share of it that words of the corpus cover, the path
of its document and its neighbouring words. A forest of the DataFrame-based MLlib, trained
from labelled findings, tells secrets from the rest.

Everything is DataFrame functions. Words and letter pairs are counted over all documents.
Features of a candidate are made once for each distinct string, so copies cost one join.
Training takes at most ``TRAIN_ROWS`` labelled findings of each label, by order of a hash.

Defined cases: a null or empty text has no findings. Without findings of both labels there
is no forest, and every finding scores its rule's label, or 0.5. A null path has no words.
Rows that repeat both id and text are scanned once, as one document. Texts of any length are
read whole. An empty table gives no findings. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import broadcast_if_small, table, written
from .registry import query

# Words that speak for a secret, in its neighbourhood.
FOR = "token|secret|passw(?:or)?d|passphrase|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential"

# Cheap looks at one character come before those that try several lengths.
_QUOTED = r"(?<=[\"'`])(?<=[:=]\s{0,4}[\"'`])[^\s\"'`]++(?=[\"'`])"
_BARE = r"(?:[^\s\"'`,;&(){}\[\]<>]|&(?!\w{1,64}=))"
_ASSIGNED = rf"(?<=[=\s])(?<=\w\s{{0,2}}=\s{{0,2}})(?![=>]){_BARE}++"
_NAMED = rf"(?<=[:\s])(?<=:\s{{0,2}})(?<=(?i:{FOR})\w{{0,16}}[\"']?\s{{0,2}}:\s{{0,2}})(?![=:]){_BARE}++"
#: '=' is a candidate's only as padding at a value's end, not where a value follows it.
_RUN = r"[A-Za-z0-9+/_\-]{16,}+(?:={1,2}+(?![\"'`]?[A-Za-z0-9+/_\-$({<\[]))?+"
CANDIDATE = "|".join([_QUOTED, _ASSIGNED, _NAMED, _RUN])
#: No two candidates begin nearer to each other than this, as something parts them.
SHORTEST = 2
TRAIN_ROWS = 5000
TREES, DEPTH = 24, 6
WORD_COUNT = 3
AROUND = 64

# Words that speak against a secret, in its neighbourhood and in paths.
AGAINST = "sha\\d*|md5|commit|checksum|digest|hash|uuid|revision|integrity|version"
TEST_PATH = "test|mock|example|sample|fixture|doc|vendor|lock|node_modules"

FEATURES = [
    "length", "changes", "digits", "uppers", "signs", "kinds", "pair_log", "covered",
    "assigned", "quoted", "word_for", "word_against", "behind_for", "behind_against", "path_depth", "path_test",
]


def findings(docs: DataFrame) -> DataFrame:
    """One row per candidate of ``docs`` (doc_id, text, path): doc_id, k1, k2, ord, start
    (in characters), candidate, before, after, path. ``before`` and ``after`` are the
    ``AROUND`` characters of the text in front of and behind it, whatever they hold."""
    cut = docs.select(
        "doc_id",
        "path",
        F.xxhash64(F.lit(1), "doc_id", "text").alias("k1"),
        F.xxhash64(F.lit(2), "text", "doc_id").alias("k2"),
        F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("found"),
        F.split("text", CANDIDATE, -1).alias("between"),
    )
    parts = F.transform(
        F.arrays_zip("found", "between"),
        lambda x: F.struct(
            x["found"].alias("candidate"),
            F.left(x["between"], F.lit(AROUND)).alias("head"),
            F.right(x["between"], F.lit(AROUND)).alias("tail"),
            F.char_length(x["between"]).alias("gap"),
        ),
    )
    rows = cut.select("doc_id", "path", "k1", "k2", F.posexplode_outer(parts).alias("ord", "x")).select(
        "doc_id", "path", "k1", "k2", "ord", "x.*"
    )
    # Between lies one string more than candidates, the end of the text; it is kept as
    # what is behind the last one. An outer explode adds a row without any. A plain one
    # would run the patterns twice.
    rows = written(rows.filter("candidate IS NOT NULL OR ord > 0"), "findings")
    order = Window.partitionBy("k1", "k2").orderBy("ord")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    # So many neighbours fill the characters around with their candidates alone.
    near = range(1, -(-AROUND // SHORTEST) + 1)
    front = F.right(F.concat("tail", F.coalesce("candidate", F.lit(""))), F.lit(AROUND))
    back = F.left(F.concat("head", F.coalesce("candidate", F.lit(""))), F.lit(AROUND))
    return (
        rows.dropDuplicates(["k1", "k2", "ord"])
        .withColumns({"_front": front, "_back": back})
        .select(
            "doc_id",
            "k1",
            "k2",
            "ord",
            (
                F.sum(F.col("gap") + F.char_length("candidate")).over(upto)
                - F.char_length("candidate")
            ).alias("start"),
            "candidate",
            F.right(
                F.concat(*[F.lag("_front", i, "").over(order) for i in reversed(near)], "tail"),
                F.lit(AROUND),
            ).alias("before"),
            F.left(
                F.concat(*[F.lead("_back", i, "").over(order) for i in near]), F.lit(AROUND)
            ).alias("after"),
            "path",
        )
        .filter("candidate IS NOT NULL")
    )


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the lower-case words of letters in all of ``docs`` with their counts."""
    return (
        docs.select(F.explode_outer(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("word"))
        .filter(F.col("word").rlike(r"^\p{L}{2,}$"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def pair_logs(words: DataFrame) -> DataFrame:
    """(pair, pair_log): log probability of the second letter after the first, for the at
    most 26 * 26 pairs of a-z, smoothed so that every pair has one."""
    places = F.expr("sequence(1, char_length(word) - 1)")
    pairs = (
        words.filter(F.col("word").rlike("[a-z]{2}"))
        .select("n", F.explode(F.transform(places, lambda i: F.substring("word", i, F.lit(2)))).alias("pair"))
        .filter(F.col("pair").rlike("^[a-z]{2}$"))
        .groupBy("pair")
        .agg(F.sum("n").alias("n"))
    )
    spark = words.sparkSession
    letters = spark.range(26).select(F.char(F.col("id") + 97).alias("x"))
    every = letters.select(
        F.explode(F.transform(F.sequence(F.lit(97), F.lit(122)), lambda i: F.concat("x", F.char(i)))).alias("pair")
    )
    full = every.join(pairs, "pair", "left").select("pair", (F.coalesce("n", F.lit(0)) + 1).alias("n"))
    after = Window.partitionBy(F.substring("pair", 1, 1))
    return full.select("pair", F.log(F.col("n") / F.sum("n").over(after)).alias("pair_log"))


def described(candidates: DataFrame, words: DataFrame) -> DataFrame:
    """Features of distinct ``candidates`` (candidate)."""
    low = F.lower("candidate")
    size = F.char_length("candidate").cast("double")
    count = lambda letters: F.regexp_count("candidate", F.lit(letters)) / size
    # Neighbouring characters of different classes: lower, upper, digit, other.
    classes = F.regexp_replace(
        F.regexp_replace(F.regexp_replace("candidate", "[a-z]", "l"), "[A-Z]", "u"), "[0-9]", "d"
    )
    change = F.regexp_count(classes, F.lit(r"(?=lu|ld|l[^lud]|ul|ud|u[^lud]|dl|du|d[^lud]|[^lud][lud])"))
    own = candidates.select(
        "candidate",
        size.alias("length"),
        (change / size).alias("changes"),
        count("[0-9]").alias("digits"),
        count("[A-Z]").alias("uppers"),
        count("[^A-Za-z0-9]").alias("signs"),
        (F.size(F.array_distinct(F.split("candidate", ""))) / size).alias("kinds"),
    )
    # A candidate of one character has no pair.
    places = F.expr("slice(sequence(0, char_length(candidate) - 1), 2, 2147483647)")
    logs = (
        candidates.select(
            "candidate",
            F.explode(F.transform(places, lambda i: F.substring(low, i, F.lit(2)))).alias("pair"),
        )
        .join(F.broadcast(written(pair_logs(words), "pairs")), "pair", "left")
        .groupBy("candidate")
        # A pair with a digit or sign is no transition between letters.
        .agg(F.coalesce(F.avg(F.coalesce("pair_log", F.lit(-8.0))), F.lit(-8.0)).alias("pair_log"))
    )
    covered = (
        candidates.select(
            "candidate",
            F.explode(F.regexp_extract_all(low, F.lit("[a-z]{3,}"), F.lit(0))).alias("word"),
        )
        .join(words.filter(F.col("n") >= WORD_COUNT).select("word"), "word")
        .groupBy("candidate")
        .agg(F.sum(F.char_length("word")).alias("covered"))
    )
    return (
        own.join(logs, "candidate", "left")
        .join(covered, "candidate", "left")
        .withColumns(
            {
                "pair_log": F.coalesce("pair_log", F.lit(-8.0)),
                "covered": F.coalesce(F.col("covered") / F.col("length"), F.lit(0.0)),
            }
        )
    )


def featured(found: DataFrame, docs: DataFrame) -> DataFrame:
    words = written(vocabulary(docs), "words")
    distinct = written(found.select("candidate").distinct(), "candidates")
    told = written(described(distinct, words), "described")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return found.join(told, "candidate").withColumns(
        {
            "assigned": flag(F.col("before").rlike(r"[:=]\s*[\"'`]?$")),
            "quoted": flag(F.col("before").rlike("[\"'`]$")),
            "word_for": flag(F.col("before").rlike(rf"(?i)(?:{FOR})\W{{0,6}}(?:\w+\W{{1,4}}){{0,2}}$")),
            "word_against": flag(F.col("before").rlike(rf"(?i)(?:{AGAINST})\W{{0,6}}(?:\w+\W{{1,4}}){{0,2}}$")),
            "behind_for": flag(F.col("after").rlike(rf"(?i)^\W{{0,6}}(?:\w+\W{{1,4}}){{0,2}}\w*(?:{FOR})")),
            "behind_against": flag(F.col("after").rlike(rf"(?i)^\W{{0,6}}(?:\w+\W{{1,4}}){{0,2}}\w*(?:{AGAINST})")),
            "path_depth": F.coalesce(F.regexp_count("path", F.lit("/")), F.lit(0)).cast("double"),
            "path_test": flag(F.col("path").rlike(rf"(?i)(?:{TEST_PATH})")),
        }
    )


def label_by_rule() -> Column:
    """Labels for want of reviewed ones: a mixed string assigned to a name that speaks of
    secrets is one; words, plain numbers and named digests are not; the rest is open."""
    mixed = F.col("candidate").rlike("[0-9]") & F.col("candidate").rlike("[A-Za-z]")
    return (
        F.when(mixed & (F.col("assigned") > 0) & (F.col("word_for") > 0), 1)
        .when(~mixed | (F.col("word_against") > 0), 0)
        .cast("int")
    )


def train(labelled: DataFrame):
    """A forest from ``labelled`` findings (features and label 0 or 1), or None without
    findings of both labels."""
    order = F.xxhash64("candidate", "k1", "k2", "ord")
    part = [
        labelled.filter(F.col("label") == value).orderBy(order).limit(TRAIN_ROWS)
        for value in (0, 1)
    ]
    sample = written(part[0].unionByName(part[1]).select(*FEATURES, "label"), "sample")
    if sample.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(
        labelCol="label", featuresCol="vector", numTrees=TREES, maxDepth=DEPTH, seed=17
    )
    return forest.fit(VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(sample))


def scored(rows: DataFrame, model) -> DataFrame:
    """``rows`` with score, the forest's probability that a finding is a secret."""
    if model is None:
        return rows.withColumn("score", F.coalesce(F.col("label").cast("double"), F.lit(0.5)))
    seen = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(rows))
    return seen.withColumn("score", vector_to_array("probability")[1])


def scan(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Findings of ``docs`` (doc_id, text, path) with the forest's judgement.

    ``labels`` (doc_id, start, label) are reviewed findings; without them, rules label.
    Returns doc_id, start, length, candidate, score, is_secret.
    """
    rows = written(featured(findings(docs), docs), "featured")
    if labels is None:
        rows = rows.withColumn("label", label_by_rule())
    else:
        known = labels.groupBy("doc_id", "start").agg(F.max("label").cast("int").alias("label"))
        rows = rows.join(known, ["doc_id", "start"], "left")
    judged = scored(rows, train(rows.filter("label IS NOT NULL")))
    return judged.select(
        "doc_id",
        F.col("start").cast("bigint").alias("start"),
        F.char_length("candidate").cast("bigint").alias("length"),
        "candidate",
        "score",
        (F.col("score") >= 0.5).alias("is_secret"),
    )


@query("op10_secret_scan")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return scan(docs.select("doc_id", "text", F.col("source").alias("path")))

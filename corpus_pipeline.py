"""From raw documents to packed training sequences, stage by stage.

Defined cases are those of the operators. A document whose text is null, has no letter or
lies between languages is rejected by the first stage; one that had lines and loses all of
them to other documents is dropped by the second. ``n_chars`` follows the text. Extra
columns stay up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from uttermark.llm.common import new_path, table
from uttermark.llm.decontam import without_contaminated
from uttermark.llm.langid import MADE, identify, learn
from uttermark.llm.lines import dedup_lines
from uttermark.llm.minhash import without_near_duplicates
from uttermark.llm.packing import pack


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    known = learn(docs.select("doc_id", "text", "lang"), F.lit(True))
    own = {c: f"_own_{c}" for c in docs.columns if c in MADE}
    kept = identify(docs.withColumnsRenamed(own), known).filter("NOT rejected")
    return kept.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = dedup_lines(docs, counts=("_all_lines", "_gone_lines"))
    kept = found.filter("_gone_lines = 0 OR text rlike '\\\\S'")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        kept = kept.withColumn("n_chars", F.char_length("text").cast(kind))
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: Compressed sizes, signatures and a tokenizer's ids are beyond SQL; tests compare each
#: stage with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each is written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def load():
    """The query ``pipeline`` and its SQL twin, if any."""
    return {"pipeline": run}, {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}

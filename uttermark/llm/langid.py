"""Language identification by compression.

For every language, text of labelled rows becomes a raw-content dictionary of zstandard.
A text is compressed with each dictionary, block by block so that its own repetitions
weigh little; the language of the smallest total wins. The score is the share by which
the runner-up is larger. A text is rejected if it has no letter, or if the score is under
``margin`` while the text is long enough to tell.

Learning takes every language. It takes, by order of a hash, at most ``SAMPLES`` pieces of
``PIECE`` characters for each; of more than ``FULL`` languages so many fewer, but one at
least, that all dictionaries together stay as large as those of ``FULL``. Prediction reads whole texts, and nothing but texts.

Defined cases: a null text or one without a letter is ``und`` with score 0 and rejected.
A tie goes to the language with more labelled rows. Without any labelled row all is
``und``. Rows without language teach nothing. Repeated rows are predicted alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import table
from .registry import query

FULL = 256
SAMPLES = 128
PIECE = 1024
BLOCK = 4096
LEVEL = 6
#: In short texts single bytes decide; a finer search costs little there.
SHORT, SHORT_LEVEL = 512, 12
MARGIN = 0.01
#: Texts of fewer bytes of letters may tie for want of evidence and are not rejected for it.
EVIDENCE = 24

UNKNOWN = "und"
MADE = ("lang_pred", "score", "rejected")
APART = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """Lower-case words of letters alone: digits, marks and symbols tell no language."""
    return APART.sub(" ", text.lower()).strip().encode()


def learn(docs: DataFrame, learn_from: Column) -> list[tuple[str, bytes]]:
    """(language, dictionary) of the labelled rows of ``docs`` (doc_id, text, lang) for
    which ``learn_from`` holds, the language with the most rows first."""
    rows = docs.filter(learn_from & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    most = max(1, min(SAMPLES, SAMPLES * FULL // max(1, len(counts))))
    room = F.greatest(F.length("text") - PIECE, F.lit(0)) + 1
    place = F.pmod(F.xxhash64("text"), room) + 1
    pieces = rows.select(
        "lang",
        F.xxhash64("doc_id", "text").alias("turn"),
        F.substring(F.col("text"), place.cast("int"), F.lit(PIECE)).alias("piece"),
    )
    # Spark limits the rank before the exchange, so no task sees a whole language.
    turn = Window.partitionBy("lang").orderBy("turn", "piece")
    sample = (
        pieces.withColumn("rank", F.row_number().over(turn))
        .filter(F.col("rank") <= most)
        .orderBy("lang", "rank")
        .collect()
    )
    by: dict[str, dict[bytes, None]] = {r["lang"]: {} for r in counts}
    for r in sample:
        by[r["lang"]][letters(r["piece"])] = None
    return [(lang, b" ".join(found)) for lang, found in by.items()]


class Classifier:
    def __init__(self, dictionaries: list[tuple[str, bytes]]):
        self.names = [name for name, _ in dictionaries]
        self.coders = {
            level: [self._coder(data, level) for _, data in dictionaries]
            for level in (LEVEL, SHORT_LEVEL)
        }

    @staticmethod
    def _coder(data: bytes, level: int):
        import zstandard

        known = zstandard.ZstdCompressionDict(
            data or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT
        )
        known.precompute_compress(level=level)
        return zstandard.ZstdCompressor(
            level=level,
            dict_data=known,
            write_content_size=False,
            write_checksum=False,
            write_dict_id=False,
        )

    def __call__(self, text: str | None, margin: float) -> tuple[str, float, bool]:
        data = letters(text) if text else b""
        if not data or not self.names:
            return UNKNOWN, 0.0, True
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        coders = self.coders[SHORT_LEVEL if len(data) <= SHORT else LEVEL]
        sizes = np.array([sum(len(c.compress(b)) for b in blocks) for c in coders])
        best = int(sizes.argmin())
        rest = np.delete(sizes, best)
        score = float((rest.min() - sizes[best]) / rest.min()) if len(rest) else 1.0
        return self.names[best], score, score < margin and len(data) >= EVIDENCE


def identify(
    docs: DataFrame, dictionaries: list[tuple[str, bytes]], margin: float = MARGIN
) -> DataFrame:
    """``docs`` with the columns lang_pred, score and rejected in place of any of those."""
    known = docs.sparkSession.sparkContext.broadcast(dictionaries)
    kept = docs.drop(*MADE)
    at = kept.columns.index("text")
    schema = T.StructType(
        [
            *kept.schema.fields,
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("rejected", T.BooleanType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(known.value)
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                batch = whole.slice(i, 1024)
                found = [classify(t.as_py(), margin) for t in batch.column(at)]
                lang, score, rejected = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns,
                        pa.array(lang, pa.string()),
                        pa.array(score, pa.float64()),
                        pa.array(rejected, pa.bool_()),
                    ],
                    names=[*batch.schema.names, *MADE],
                )

    return kept.mapInArrow(run, schema)


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


@query("op2_language_id")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    known = learn(docs, ~held_out())
    found = identify(docs.select("doc_id", "text"), known)
    return found.select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score",
        "rejected",
    )

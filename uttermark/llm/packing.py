"""Packing of tokenized documents by shortest-pack-first over the length histogram.

Documents are tokenized once, in tasks, and cut at multiples of the sequence length. Only
the histogram of piece lengths (at most one count per length) reaches the driver, where
lengths are placed longest first, each into the shortest packs that have room; what is
kept there are packing patterns with counts, never pieces. Pieces then find their place by
their rank within their length. Ranks come from windows over (length, slice), of which
there are 1024 for each length, so a length that a third of all pieces share is spread.

Defined cases: a null text is an empty one, of which only the end id is left. Repeated
rows are packed as often as they occur. A null id is an id like any other. Texts of any
length are tokenized whole. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import table, written
from .registry import query

SEQUENCE = 2048
END = 1
SLICES = 1024
CACHE_WORDS = 1 << 19

# The word pattern of the tokenizer file, here over the characters below.
LETTERS = "a-zªµºÀ-ÖØ-öø-ſ"
NUMBERS = "0-9²³¹¼-¾"
WORDS = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\\s{LETTERS}{NUMBERS}]+"
)
#: Texts of these characters alone are in normal form, and lower-case letter by letter.
PLAIN = re.compile("[\t\n\r\x20-\x7e¡-įı-ſ]*")


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds:
    """Ids of a text as little-endian unsigned 32-bit integers. Plain texts go word by
    word through a bounded cache; any other text takes the tokenizer as a whole. Both give
    the same ids, as tests confirm."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.cache: dict[str, bytes] = {}

    def _word(self, chunk: str) -> bytes:
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
        ids: list[int] = []
        for word in WORDS.findall(chunk):
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(self.letters)
            ids += [t.id for t in self.tokenizer.model.tokenize(word)]
        out = self.cache[chunk] = np.array(ids, "<u4").tobytes()
        return out

    def __call__(self, text: str) -> bytes:
        if PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            get, word = self.cache.get, self._word
            return b"".join([get(c) or word(c) for c in text.lower().split()])
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()


_LOADED: dict[str, WordIds] = {}  # one per worker, which serves many tasks


def word_ids(path: str) -> WordIds:
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


PIECE = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
    ]
)


def _pieces(path: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = word_ids(path), np.array([END], "<u4").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                rows = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = ids_of(text.as_py() or "") + end
                    n = len(ids) // 4
                    for start in range(0, n, size):
                        part = ids[4 * start : 4 * (start + size)]
                        rows.append((doc, start, len(part) // 4, zlib.crc32(part), n))
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), PIECE)]
                yield pa.RecordBatch.from_arrays(columns, schema=PIECE)

    return run


def pack_lengths(histogram: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (number of packs, lengths in them) for a histogram of lengths."""
    room: dict[int, Counter] = {}  # by room left: pattern -> packs
    rooms: list[int] = []  # the rooms in use, ascending

    def put(left: int, pattern: tuple, n: int) -> None:
        if left not in room:
            room[left] = Counter()
            bisect.insort(rooms, left)
        room[left][pattern] += n

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            left = rooms[-1] if rooms else 0
            if left < length:  # no pack has room: open new ones, filled with this length
                each = size // length
                if n // each:
                    put(size - each * length, ((length, each),), n // each)
                if n % each:
                    put(size - n % each * length, ((length, n % each),), 1)
                break
            pattern, packs = room[left].popitem()
            used = min(packs, n)
            if used < packs:
                room[left][pattern] = packs - used
            elif not room[left]:
                del room[left]
                rooms.pop()
            last, times = pattern[-1]
            grown = (*pattern[:-1], (last, times + 1)) if last == length else (*pattern, (length, 1))
            put(left - length, grown, used)
            n -= used
    return [
        (packs, tuple(x for x, times in pattern for _ in range(times)))
        for left in sorted(room)
        for pattern, packs in sorted(room[left].items())
    ]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[int, np.ndarray]:
    """For each length the runs of ranks: first rank, first sequence, offset."""
    ranks, first, found = Counter(), 0, {}
    for packs, pattern in patterns:
        offset = 0
        for length in pattern:
            found.setdefault(length, []).append((ranks[length], first, offset))
            ranks[length] += packs
            offset += length
        first += packs
    return {k: np.array(v, np.int64) for k, v in found.items()}


PACKED = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint"
)


def _place(runs: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(2).to_numpy()
            ranks = batch.column(5).to_numpy()
            sequence, offset = np.empty_like(ranks), np.empty_like(ranks)
            for length in np.unique(lengths).tolist():
                at, run = np.flatnonzero(lengths == length), runs[length]
                row = run[np.searchsorted(run[:, 0], ranks[at], side="right") - 1]
                sequence[at] = row[:, 1] + ranks[at] - row[:, 0]
                offset[at] = row[:, 2]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                names=[*PIECE.names, "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of at most ``size`` ids.

    ``tokenizer`` is the path of the tokenizer file on every machine. Returns one row per
    piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    pieces = written(
        docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
            _pieces(tokenizer, size), PACKED.split(", sequence_id")[0]
        ),
        "pieces",
    )
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs = slots(pack_lengths(histogram, size))

    sliced = pieces.withColumn(
        "slice", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(SLICES))
    )
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sliced.groupBy("length", "slice").count().select(
        "length", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("earlier")
    )
    # Rows that tie in all five columns are equal, so a rerun gives the same packing.
    inside = Window.partitionBy("length", "slice").orderBy(
        "doc_id", "start", "ids_crc32", "doc_tokens"
    )
    ranked = sliced.withColumn("place", F.row_number().over(inside)).join(
        offsets, ["length", "slice"]
    )
    return ranked.select(
        *PIECE.names, (F.col("earlier") + F.col("place") - 1).cast("bigint").alias("rank")
    ).mapInArrow(_place(runs), PACKED)


@query("op9_sequence_packing")
def op9(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from uttermark.llm.packing import WordIds, pack, pack_lengths, slots

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def ids(tokenizer, text):
    return tokenizer.encode(text, add_special_tokens=False).ids


@given(st.text(max_size=40) | st.text("aZ's ÄéßſŉİΣ½²\x1c\x85\xa0<|>endoftxsar.1", max_size=40))
@settings(max_examples=400, deadline=None)
def test_words_through_the_cache_get_the_ids_of_the_tokenizer(text):
    own = WordIds(PATH) if not hasattr(test_packing, "own") else test_packing.own
    test_packing.own = own
    assert np.frombuffer(own(text), "<u4").tolist() == ids(own.tokenizer, text)


class test_packing:  # holds the tokenizer between examples
    pass


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
@settings(max_examples=200, deadline=None)
def test_patterns_hold_every_piece_once_and_fit(histogram):
    patterns = pack_lengths(histogram, 64)
    assert all(n > 0 and sum(p) <= 64 for n, p in patterns)
    held = Counter()
    for n, p in patterns:
        for length in p:
            held[length] += n
    assert held == Counter(histogram)
    for length, runs in slots(patterns).items():
        assert runs[0, 0] == 0 and (np.diff(runs[:, 0]) > 0).all()


def test_packing_is_exact(spark, plain):
    rows = [(i, "some words of text " * (7 * i)) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "<|endoftext|> é 日本"), (None, "null id"), (5, rows[5][1])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", start int")
    got = pack(docs, size=256).collect()
    want = Counter()
    for d, t in rows:
        all_ids = [*ids(plain, t or ""), 1]
        for s in range(0, len(all_ids), 256):
            part = np.array(all_ids[s : s + 256], "<u4")
            want[d, s, len(part), zlib.crc32(part.tobytes()), len(all_ids)] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
        assert sum(n for _, n in parts) <= 256
    assert sorted(sequences) == list(range(len(sequences)))
    assert sum(n for p in sequences.values() for _, n in p) > 0.97 * 256 * len(sequences)
    assert pack(docs.limit(0)).count() == 0

"""All queries of this subpackage and their SQL twins, by name."""

from __future__ import annotations

from . import (  # noqa: F401
    decontam, embeddings, htmltext, langid, lines, manifest, minhash, negatives, packing, pii,
    secrets, topk, warc,
)
from .registry import ORACLES, QUERIES


def load():
    return QUERIES, ORACLES

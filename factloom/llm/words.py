"""Words of a text, and 128-bit codes of them that are the same in every task."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa

#: Keys of two keyed hashes (SipHash): no polynomial, so unequal words do not meet by their form.
KEYS = ("factloom-words-a", "factloom-words-b")


def split(data: bytes) -> list[bytes]:
    """Maximal runs of bytes other than ASCII white space."""
    return data.split()


def codes(words: list[bytes], lanes: int = 2) -> list[np.ndarray]:
    """``lanes`` independent 64-bit codes of each word; a word is hashed once however often it occurs in the list."""
    if not words:
        return [np.empty(0, np.uint64)] * lanes
    known = pa.array(words, pa.binary()).dictionary_encode()
    at, distinct = known.indices.to_numpy(), np.array([*known.dictionary.to_pylist(), None], object)[:-1]
    return [pd.util.hash_array(distinct, hash_key=key, categorize=False)[at] for key in KEYS[:lanes]]

"""Word shingles of texts laid end to end, as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from haulframe.llm.common import SpanHash, seeded, utf8, words


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts in lower case; null is empty."""
    return utf8(pc.utf8_lower(column.cast(pa.large_string())))


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of ``size`` consecutive words, with the text of each, in that order.

    A text of fewer words, but not none, has one shingle of all of them.
    """
    # one blank between texts, so that no word runs into the next text
    texts = len(offsets) - 1
    place = np.arange(len(data)) + np.repeat(np.arange(texts), np.diff(offsets))
    spread = np.full(len(data) + texts, 32, np.uint8)
    spread[place] = data
    begins, ends = words(spread)
    if not len(begins):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner = np.searchsorted(offsets[1:] + np.arange(1, texts + 1), begins, side="right")
    word = SpanHash(spread)(begins, ends)
    n = len(word)
    rolled = np.zeros(n, np.uint64)
    whole = np.zeros(n, bool)
    if n >= size:
        whole[:n - size + 1] = owner[size - 1:] == owner[:n - size + 1]
    per_text = np.bincount(owner, minlength=texts)
    first = np.concatenate([[0], np.cumsum(per_text)[:-1]])
    short = np.flatnonzero((per_text > 0) & (per_text < size))
    for i in range(size):
        reach = np.zeros(n, np.uint64)
        reach[:n - i] = seeded(word[i:], i)
        inside = np.zeros(n, bool)
        inside[:n - i] = owner[i:] == owner[:n - i]
        rolled += np.where(inside, reach, np.uint64(0))
    whole[first[short]] = True
    value, owner = seeded(rolled[whole], 31), owner[whole]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[fresh], owner[fresh]

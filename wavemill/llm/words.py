"""Words and word-shingle hashes of whole Arrow batches, without a Python loop over words.

A text is cut at byte level: a word is a longest run of bytes of a class. As
every byte of a multi-byte UTF-8 character is at or above 0x80, the classes
below are exactly the regular expressions in their comments.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BYTES = np.arange(256)
#: [^\x20\x09-\x0D]+
NON_SPACE = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z became lower case
ALNUM = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | ((_BYTES >= 0x41) & (_BYTES <= 0x5A)) | (_BYTES >= 0x80)
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint64)
ASIS = _BYTES.astype(np.uint64)

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_NGRAM = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective scramble of 64-bit values (the public splitmix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of some texts: byte spans in ``data``, 64-bit hashes, and where each text's words begin."""

    data: np.ndarray
    offsets: np.ndarray  # of the texts in data, one more than texts
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # of the texts in start, one more than texts


def texts_of(column: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of a string column of about ``most`` bytes: first row, bytes, offsets.

    Nulls are empty. A text longer than ``most`` makes a slice alone, and is whole.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield at, data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def words_of(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, fold: np.ndarray) -> Words:
    inside = kind[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    begins = inside & (~before | edge[:-1])
    start = np.flatnonzero(begins)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    if len(start):
        place = np.arange(len(data)) - np.repeat(start, np.diff(np.append(start, len(data)))) if start[0] == 0 else np.concatenate([np.zeros(start[0], np.int64), np.arange(start[0], len(data)) - np.repeat(start, np.diff(np.append(start, len(data))))])
        longest = int((end - start).max())
        power = np.multiply.accumulate(np.full(longest + 1, _BASE))
        value = np.where(inside, (fold[data] + np.uint64(1)) * power[np.minimum(place, longest)], np.uint64(0))
        h = mixed(np.add.reduceat(value, start) + (end - start).astype(np.uint64))
    else:
        h = np.zeros(0, np.uint64)
    return Words(data, offsets, start, end, h, np.searchsorted(start, offsets))


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles, text after text, and their offsets.

    A text of 1 to k - 1 words has one shingle of all its words; one without words has none.
    """
    n = np.diff(w.first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    offs = np.concatenate([[0], np.cumsum(count)])
    base = np.repeat(w.first[:-1] - offs[:-1], count) + np.arange(offs[-1])
    padded = np.concatenate([w.hash, np.zeros(k, np.uint64)])
    out = np.zeros(len(base), np.uint64)
    size = np.repeat(np.minimum(n, k), count)
    for j in range(k):
        out = out * _NGRAM + np.where(j < size, padded[base + j], np.uint64(j + 1))
    return mixed(out), offs

"""Vectorised word and shingle hashing over the UTF-8 buffers of Arrow string columns.

Words are maximal runs of `[^\\x20\\x09-\\x0D]`. A word's hash is a polynomial over its bytes modulo 2**64, taken from
prefix sums, so no Python object is made per word. Work goes in blocks of about 1 MB of text, which bounds memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
#: At most so many documents in a block: 12 bits of a sort key.
BLOCK_DOCS = 1 << 12
U = np.uint64


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """splitmix64's finaliser."""
    with np.errstate(over="ignore"):
        x = x + U((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


_BASE = 0x5851F42D4C957F2D
_powers: list[np.ndarray] = [np.ones(0, U), np.ones(0, U)]
_BYTES = mix(np.arange(256, dtype=U), 7)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_FOLDED = _BYTES[_LOWER]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            p = np.full(max(n, BLOCK_BYTES), base, U)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=U)
    return _powers[0], _powers[1]


class Block(NamedTuple):
    """Some consecutive texts of a batch: the first row, each text's end within `data`, and the bytes."""

    first: int
    data: np.ndarray
    bounds: np.ndarray  # n + 1 offsets into data


def blocks(texts: pa.Array, size: int = BLOCK_BYTES, docs: int = BLOCK_DOCS - 1) -> Iterator[Block]:
    """Cut a string column (nulls count as empty) into blocks of about `size` bytes; a longer text stands alone."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at, n = 0, len(texts)
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        to = min(max(to, at + 1), at + docs, n)
        yield Block(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


class Words(NamedTuple):
    start: np.ndarray
    end: np.ndarray  # exclusive
    doc: np.ndarray
    hash: np.ndarray


def words(b: Block, lower: bool, inside: np.ndarray | None = None) -> Words:
    """All words of a block in order, with the block's document number and a 64-bit hash. inside: the bytes of words, by
    default all but white space."""
    data, n = b.data, len(b.data)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(z, z, z, np.zeros(0, U))
    inside = ~_SPACE[data] if inside is None else inside[data]
    cut = np.zeros(n + 1, bool)
    cut[b.bounds] = True
    start = np.flatnonzero(inside & (cut[:n] | np.concatenate(([True], ~inside[:-1]))))
    end = np.flatnonzero(inside & (cut[1:] | np.concatenate((~inside[1:], [True])))) + 1
    up, down = powers(n)
    with np.errstate(over="ignore"):
        sums = np.empty(n + 1, U)
        sums[0] = 0
        np.cumsum((_FOLDED if lower else _BYTES)[data] * up[:n], out=sums[1:])
        h = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U))
    return Words(start, end, np.searchsorted(b.bounds, start, "right") - 1, h)


def spans_hash(b: Block, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """Hash of the bytes of each span."""
    up, down = powers(max(len(b.data), 1))
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, U), np.cumsum((_FOLDED if lower else _BYTES)[b.data] * up[: len(b.data)], dtype=U)))
        return mix((sums[end] - sums[start]) * down[np.minimum(start, len(down) - 1)] + (end - start).astype(U), 3)


def windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word and hash of every run of `size` words within one document."""
    n = len(w.hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    at = np.flatnonzero(w.doc[:n] == w.doc[size - 1 :])
    with np.errstate(over="ignore"):
        h = np.zeros(len(at), U)
        for k in range(size):
            h = h * U(0xD1342543DE82EF95) + w.hash[at + k]
    return at, mix(h, size)


MASK52 = U((1 << 52) - 1)


class Sets(NamedTuple):
    """Shingle sets of a block's documents: sorted by document and element, each element once."""

    doc: np.ndarray
    element: np.ndarray  # 52 bits
    size: np.ndarray  # per document


def shingle_sets(b: Block, size: int = 5) -> Sets:
    """Distinct `size`-word shingles of each text, lower-cased in A-Z; of fewer words, the whole sequence as one."""
    w = words(b, lower=True)
    docs = len(b.bounds) - 1
    at, h = windows(w, size)
    doc = w.doc[at]
    count = np.bincount(w.doc, minlength=docs)
    few = np.flatnonzero((count > 0) & (count < size))
    if len(few):
        first = np.searchsorted(w.doc, few)
        with np.errstate(over="ignore"):
            own = np.zeros(len(few), U)
            for k in range(size - 1):
                live = k < count[few]
                own[live] = own[live] * U(0xD1342543DE82EF95) + w.hash[first[live] + k]
        doc, h = np.concatenate((doc, few)), np.concatenate((h, mix(own + count[few].astype(U), 99)))
    key = np.sort((doc.astype(U) << U(52)) | (h >> U(12)))
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    doc = (key >> U(52)).astype(np.int64)
    return Sets(doc, key & MASK52, np.bincount(doc, minlength=docs))


def sum_by(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums modulo 2**64 of 64-bit values for each index below n (exact: 32-bit halves in doubles)."""
    low = np.bincount(index, (values & U(0xFFFFFFFF)).astype(np.float64), n)
    high = np.bincount(index, (values >> U(32)).astype(np.float64), n)
    with np.errstate(over="ignore"):
        return low.astype(U) + (high.astype(U) << U(32))

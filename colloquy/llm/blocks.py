"""Vectorised views of text columns inside Arrow tasks: words, word hashes and window hashes.

Everything here works on one block of at most ``BLOCK_BYTES`` of UTF-8 (a longer text is a block of
its own, or is cut into overlapping pieces by the caller), so a task's memory doesn't grow with the
number of rows in a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE_FOLDED = _BYTE.copy()
_BYTE_FOLDED[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(20, (n - 1).bit_length())
        steps = np.full(size + 1, base, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if n > (1 << 21):
            return have  # not kept: one very long text
        _POWERS[base] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Block:
    """Some texts of a batch: ``rows`` are their positions in the batch, ``offsets`` the bounds in ``data``."""

    rows: range
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.rows)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n+1 offsets; null counts as empty."""
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not wide and not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        return text_buffer(column.cast(pa.large_string()))
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, bounds, data = column.buffers()
    offsets = np.frombuffer(bounds, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return flat, offsets - offsets[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts of ``column`` in blocks of at most ``limit`` bytes, or one longer text each."""
    data, offsets = text_buffer(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield Block(range(at, to), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def word_bounds(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text index of every word ``[^\\x20\\x09-\\x0D]+``."""
    data, offsets = block.data, block.offsets
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~_SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    inner = offsets[1:-1]
    cut = inner[(inner > 0) & (inner < n)]
    begins[cut] |= inside[cut]
    ends[cut - 1] |= inside[cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def prefix_sums(data: np.ndarray, fold: bool = False) -> np.ndarray:
    """Sums from which :func:`span_hash` takes the hash of any span; ``fold`` lower-cases A-Z."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum((_BYTE_FOLDED if fold else _BYTE)[data] * _powers(_BASE, len(data))[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, equal for equal bytes wherever they stand."""
    inverse = _powers(_BASE_INVERSE, len(sums))
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def window_hash(sums: np.ndarray, width: int) -> np.ndarray:
    """The hash of each window of ``width`` bytes."""
    n = len(sums) - width
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix((sums[width:] - sums[:n]) * _powers(_BASE_INVERSE, n)[:n])


def word_hashes(block: Block, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word and its text's index."""
    start, end, doc = word_bounds(block)
    return span_hash(prefix_sums(block.data, fold), start, end), doc


def shingle_hashes(words: np.ndarray, doc: np.ndarray, n_docs: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` words in a row with their text's index; a shorter text is one shingle."""
    counts = np.bincount(doc, minlength=n_docs)
    step = np.uint64(0xD6E8FEB86659FD93)

    def joined(first: np.ndarray, length: int) -> np.ndarray:
        h = np.full(len(first), length, np.uint64)
        for k in range(length):
            h = mix(h * step + words[first + k])
        return h

    first = np.arange(max(0, len(words) - width + 1))
    first = first[doc[first] == doc[first + width - 1]] if len(first) else first
    parts, docs = [joined(first, width)], [doc[first]]
    begin = np.cumsum(counts) - counts
    for length in range(1, width):
        short = np.flatnonzero(counts == length)
        if len(short):
            parts.append(joined(begin[short], length))
            docs.append(short)
    h, d = np.concatenate(parts), np.concatenate(docs)
    order = np.argsort(d, kind="stable")
    return h[order], d[order]


def distinct_sets(h: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, one after another, and n+1 bounds. ``doc`` is sorted."""
    cuts = np.searchsorted(doc, np.arange(n_docs + 1))
    sets = [np.unique(h[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    bounds = np.zeros(n_docs + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=bounds[1:])
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), bounds


def binary_column(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())

"""Benchmark decontamination by greedy string tiling.

Texts are lower-cased words. Seeds are ``MATCH`` words in a row, found by their Karp-Rabin hashes; a
document meets a test item where they share a seed. Shared seeds on one diagonal run together into
maximal matches; the longest is marked as a tile, what it overlaps is cut back to unmarked words, and
so on until no match of ``MATCH`` words is left. Tiles may stand in any order, so reordered passages
count too. An item is leaked when tiles cover ``COVERAGE`` of its words.

The benchmark is the query set: it goes to the tasks in blocks of about ``BLOCK_BYTES`` of text, each a
pass over all documents. Blocks are cut within hash buckets, so no task sorts the whole benchmark, and
only one block is on the driver at a time.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.storage import checkpointed
from colloquy.llm.blocks import blocks, shingle_hashes, word_hashes

__all__ = ["greedy_tiles", "leaked_items"]

MATCH = 4
COVERAGE = 0.5
BLOCK_BYTES = 16 << 20
#: Seed pairs of several texts that are matched at once.
PAIRS = 1 << 21


def greedy_tiles(item_at: np.ndarray, doc_at: np.ndarray, match: int) -> list[tuple[int, int, int]]:
    """Tiles (item position, document position, words) from seed pairs of ``match`` equal words.

    Longest first; ties by item position, then document position.
    """
    order = np.lexsort((item_at, doc_at - item_at))
    i, j = item_at[order], doc_at[order]
    fresh = np.append(True, (np.diff(j - i) != 0) | (np.diff(i) != 1)) if len(i) else np.zeros(0, bool)
    first = np.flatnonzero(fresh)
    length = np.diff(np.append(first, len(i))) + match - 1
    queue = [(-int(n), int(a), int(b)) for n, a, b in zip(length, i[first], j[first], strict=True)]
    heapq.heapify(queue)
    items, docs, tiles = set(), set(), []
    while queue:
        n, a, b = heapq.heappop(queue)
        free = [k for k in range(-n) if a + k not in items and b + k not in docs]
        if len(free) == -n:
            items.update(range(a, a - n))
            docs.update(range(b, b - n))
            tiles.append((a, b, -n))
            continue
        start = 0
        for k in range(1, len(free) + 1):
            if k == len(free) or free[k] != free[k - 1] + 1:
                if k - start >= match:
                    heapq.heappush(queue, (start - k, a + free[start], b + free[start]))
                start = k
    return tiles


@dataclass
class _Items:
    """A block of test items: seeds by length, each with its item and position."""

    ids: np.ndarray
    sizes: np.ndarray
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def _seed_index(ids: list[int], texts: list[str], match: int) -> _Items:
    parts: dict[int, list] = {}
    sizes = np.zeros(len(ids), np.int64)
    for block in blocks(pa.array(texts, pa.large_string())):
        words, doc = word_hashes(block)
        count = np.bincount(doc, minlength=len(block))
        sizes[block.rows.start : block.rows.stop] = count
        begin = np.cumsum(count) - count
        for width in range(1, match + 1):
            own = (count >= match) if width == match else (count == width)
            keep = own[doc]
            if not keep.any():
                continue
            h, at = _seeds(words, doc, width)
            mine = own[doc[at]]
            parts.setdefault(width, []).append((h[mine], doc[at][mine] + block.rows.start, (at - begin[doc[at]])[mine]))
    seeds = {}
    for width, found in parts.items():
        h, item, at = (np.concatenate([x[k] for x in found]) for k in range(3))
        order = np.argsort(h, kind="stable")
        seeds[width] = (h[order], item[order], at[order])
    return _Items(np.array(ids, np.int64), sizes, seeds)


def _seeds(words: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` words in a row inside one text, and the place of the first."""
    at = np.arange(max(0, len(words) - width + 1))
    at = at[doc[at] == doc[at + width - 1]] if len(at) else at
    h, _ = shingle_hashes(words, np.zeros(len(words), np.int64), 1, width) if len(words) >= width else (np.zeros(0, np.uint64), None)
    return h[at], at


def _pieces(hit: np.ndarray, n: np.ndarray, text: np.ndarray) -> Iterator[np.ndarray]:
    """Slices of ``hit`` that hold whole texts and, unless one text has more, at most ``PAIRS`` seed pairs."""
    first = np.flatnonzero(np.append(True, np.diff(text) != 0))
    pairs = np.add.reduceat(n, first)
    start, held = 0, 0
    for k, more in enumerate(pairs):
        if held and held + more > PAIRS:
            yield hit[first[start] : first[k]]
            start, held = k, 0
        held += int(more)
    yield hit[first[start] :]


def _tiled(items: _Items, match: int, coverage: float):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for block in blocks(batch.column(1)):
                words, doc = word_hashes(block)
                begin = np.searchsorted(doc, np.arange(len(block)))
                out: list[tuple] = []
                for width, (seeds, seed_item, seed_at) in items.seeds.items():
                    h, at = _seeds(words, doc, width)
                    low, high = np.searchsorted(seeds, h, "left"), np.searchsorted(seeds, h, "right")
                    hit = np.flatnonzero(high > low)
                    if not len(hit):
                        continue
                    for piece in _pieces(hit, (high - low)[hit], doc[at[hit]]):
                        n = (high - low)[piece]
                        total = np.cumsum(n)
                        which = np.arange(total[-1]) + np.repeat(low[piece] - (total - n), n)
                        place = np.repeat(at[piece], n)
                        text, item, item_at = doc[place], seed_item[which], seed_at[which]
                        order = np.lexsort((item_at, item, text))
                        text, item, item_at, place = text[order], item[order], item_at[order], place[order]
                        cut = np.flatnonzero(np.append(True, (np.diff(text) != 0) | (np.diff(item) != 0)))
                        for a, b in zip(cut, np.append(cut, len(text))[1:], strict=True):
                            size = int(items.sizes[item[a]])
                            # Tiles lie within the shared seeds, which already bound the coverage.
                            spots = np.unique(item_at[a:b])
                            bound = width + np.minimum(np.diff(spots), width).sum()
                            if bound < coverage * size:
                                continue
                            tiles = greedy_tiles(item_at[a:b], place[a:b] - begin[text[a]], width)
                            covered = sum(t[2] for t in tiles)
                            if covered >= coverage * size:
                                out.append((block.rows.start + int(text[a]), int(items.ids[item[a]]), size, covered, len(tiles), max(t[2] for t in tiles)))
                if out:
                    row, item, size, covered, tiles, longest = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (item, size, covered, tiles, longest))],
                        names=["doc_id", "item_id", "item_words", "covered", "n_tiles", "longest"],
                    )

    return task


def leaked_items(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    match: int = MATCH,
    coverage: float = COVERAGE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row for each document and test item leaked into it: doc_id, item_id, item_words, covered,
    n_tiles, longest, coverage.

    Words are ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased. ``covered`` counts the item's words in tiles of at
    least ``match`` words (an item with fewer words is one tile or none), and rows have
    ``covered >= coverage * item_words``. Null and wordless documents and items match nothing. Repeated
    documents and items each give their rows; null document ids are carried, items without an id are left
    out. Memory follows the seed pairs of one text, which grow with both repetitions where a text and an
    item repeat the same words. Other columns are not read.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where(
        F.col("text").isNotNull() & F.col("item_id").isNotNull()
    )
    items = checkpointed(items.withColumn("size", F.octet_length("text").cast("long")).withColumn("key", F.xxhash64("item_id", "text")))
    buckets = 1 + (items.agg(F.sum("size")).first()[0] or 0) // block_bytes
    order = Window.partitionBy("bucket").orderBy("item_id", "key").rowsBetween(Window.unboundedPreceding, 0)
    items = items.withColumn("bucket", F.pmod("key", F.lit(buckets)))
    items = checkpointed(items.withColumn("block", F.floor((F.sum("size").over(order) - F.col("size")) / block_bytes)))
    schema = "doc_id long, item_id long, item_words long, covered long, n_tiles long, longest long"
    found = None
    names = items.select("bucket", "block").distinct().orderBy("bucket", "block").collect()
    for row in names:
        held = items.where((F.col("bucket") == row["bucket"]) & (F.col("block") == row["block"])).orderBy("item_id", "text").toArrow()
        index = _seed_index(held["item_id"].to_pylist(), held["text"].to_pylist(), match)
        part = docs.mapInArrow(_tiled(index, match, coverage), schema)
        part = checkpointed(part) if len(names) > 1 else part
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = docs.limit(0).select("doc_id", *(F.lit(0).cast("long").alias(c) for c in ("item_id", "item_words", "covered", "n_tiles", "longest")))
    return found.withColumn("coverage", F.col("covered") / F.col("item_words"))

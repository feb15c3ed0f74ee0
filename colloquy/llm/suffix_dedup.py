"""Removal of repeated passages with a logarithmic family of suffix arrays.

A byte goes when a string of ``length`` bytes that covers it also starts in a document with a smaller
id. Sorting every suffix of a corpus would move many times its size, so two steps come before:

1. Every window of ``length`` bytes has an anchor, its ``GRAM``-byte string of least hash. Equal
   windows have equal anchors, and neighbouring windows mostly share one, so about 7 % of positions
   are anchors. Anchors that two documents have are found by hash partition.
2. Only the runs of windows around such anchors travel, as bytes, to their anchor's partition. Of
   equal texts just the first takes part; the others are removed whole.

There the runs enter an index family in batches by document id. A batch gets a suffix array over its
distinct runs (suffixes ordered by their first ``length`` bytes), is merge-scanned against every
existing level for matches of ``length`` bytes, and joins the family; levels of like size merge, so a
suffix is moved a logarithmic number of times.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.storage import checkpointed
from colloquy.llm.blocks import BLOCK_BYTES, blocks, prefix_sums, span_hash, text_buffer, window_hash

__all__ = ["SuffixFamily", "remove_repeats"]

LENGTH = 50
GRAM = 24
BATCH_SUFFIXES = 50_000
#: Bytes of text for each hash partition of anchors.
PARTITION_BYTES = 32 << 20
#: Shuffle partitions at most. Of more text (4 TB) a partition has several groups, each read on its own.
MOST_TASKS = 131_072
POSITION_BITS = np.uint64(21)
_POSITION = np.uint64((1 << 21) - 1)


def anchor_of_windows(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of ``length`` bytes its anchor's position, and the hash at every position.

    The anchor is the leftmost gram whose hash, without its last bits, is least: a function of the
    window's bytes alone. ``data`` holds less than 2 MiB.
    """
    hashes = window_hash(prefix_sums(data), gram)
    least = (hashes & ~_POSITION) | np.arange(len(hashes), dtype=np.uint64)
    width, have = length - gram + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    return (least & _POSITION).astype(np.int64), hashes


def _pieces(column: pa.Array, length: int) -> Iterator[tuple[range, np.ndarray, np.ndarray, int]]:
    """Blocks of texts; a text longer than a block comes in pieces that overlap by a window."""
    for block in blocks(column):
        if len(block.data) <= BLOCK_BYTES:
            yield block.rows, block.data, block.offsets, 0
            continue
        for at in range(0, max(1, len(block.data) - length + 1), BLOCK_BYTES):
            part = block.data[at : at + BLOCK_BYTES + length - 1]
            yield block.rows, part, np.array([0, len(part)]), at


def _runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that share an anchor: text index, first window, number of windows, anchor hash."""
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    anchors, hashes = anchor_of_windows(data, length, gram)
    sizes = np.diff(offsets)
    text = np.repeat(np.arange(len(sizes)), sizes)[: len(anchors)]
    within = np.arange(len(anchors)) + length <= offsets[1:][text]
    fresh = np.empty(len(anchors), bool)
    fresh[0] = True
    fresh[1:] = (anchors[1:] != anchors[:-1]) | (text[1:] != text[:-1])
    fresh[1:] |= within[1:] != within[:-1]
    begin = np.flatnonzero(fresh)
    count = np.diff(np.append(begin, len(anchors)))
    keep = within[begin]
    begin, count = begin[keep], count[keep]
    return text[begin], begin, count, hashes[anchors[begin]]


def _joined(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


class SuffixFamily:
    """Suffix arrays of geometrically growing sizes: each level holds sorted strings of ``length``
    bytes and the smallest document id that has each."""

    def __init__(self, length: int = LENGTH) -> None:
        self.length = length
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    @staticmethod
    def suffix_array(strings: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct strings in order, with the smallest id of each."""
        order = np.lexsort((docs, strings))
        strings, docs = strings[order], docs[order]
        first = np.append(True, strings[1:] != strings[:-1]) if len(strings) else np.zeros(0, bool)
        return strings[first], docs[first]

    def scan(self, strings: np.ndarray) -> np.ndarray:
        """The smallest indexed id that has each of these sorted strings, or the largest integer."""
        best = np.full(len(strings), np.iinfo(np.int64).max)
        for level, ids in self.levels:
            at = np.minimum(np.searchsorted(level, strings), len(level) - 1)
            hit = level[at] == strings
            best[hit] = np.minimum(best[hit], ids[at[hit]])
        return best

    def add(self, strings: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Index a batch; returns for each string the smallest id that has it, the batch included."""
        level = self.suffix_array(strings, docs)
        if not len(level[0]):
            return np.zeros(0, np.int64)
        best = np.minimum(self.scan(level[0]), level[1])
        found = best[np.searchsorted(level[0], strings)]
        self.levels.append(level)
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            (a, x), (b, y) = self.levels.pop(), self.levels.pop()
            self.levels.append(self.suffix_array(np.concatenate([a, b]), np.concatenate([x, y])))
        return found


def _strings(flat: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The windows of ``length`` bytes at these places, as byte strings that sort as bytes do.

    A last byte of 1 keeps trailing zero bytes from being dropped.
    """
    out = np.ones((len(at), length + 1), np.uint8)
    out[:, :length] = np.lib.stride_tricks.sliding_window_view(flat, length)[at] if len(at) else 0
    return out.view(f"S{length + 1}").ravel()


def _pack(values: np.ndarray) -> bytes:
    """The array compressed: runs overlap and repeat, and they are most of what is shuffled."""
    raw = values.tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def _unpack(packed: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True), kind)


def _run_hashes(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each run, a block of runs at a time."""
    out = np.empty(len(at), np.uint64)
    cuts = np.flatnonzero(np.diff((at + size) // BLOCK_BYTES)) + 1
    for a, b in zip(np.append(0, cuts), np.append(cuts, len(at)), strict=True):
        if b > a:
            low, high = at[a], at[b - 1] + size[b - 1]
            out[a:b] = span_hash(prefix_sums(flat[low:high]), at[a:b] - low, at[a:b] + size[a:b] - low)
    return out


def _anchor_rows(length: int, gram: int, parts: int):
    """Distinct anchors of each document, grouped by hash partition: one row per task and partition."""

    def emit(ids: list[np.ndarray], keys: list[np.ndarray], sizes: list[np.ndarray], hashes: list[np.ndarray]) -> pa.RecordBatch:
        doc, key, h = _joined(ids, np.int64), _joined(keys, np.int64), _joined(hashes, np.uint64)
        row = np.repeat(np.arange(len(doc)), _joined(sizes, np.int64))
        part = (h >> np.uint64(32)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        h, row, part = h[order], row[order], part[order]
        names, begin = np.unique(part, return_index=True)
        out: dict[str, list] = {"part": names.astype(np.int64), "ids": [], "keys": [], "sizes": [], "hashes": []}
        for a, b in zip(begin, np.append(begin, len(part))[1:], strict=True):
            own, first = np.unique(row[a:b], return_index=True)
            out["ids"].append(doc[own].tobytes())
            out["keys"].append(key[own].tobytes())
            out["sizes"].append(np.diff(np.append(first, b - a)).astype(np.int32).tobytes())
            out["hashes"].append(h[a:b].astype(np.uint32).tobytes())
        return pa.RecordBatch.from_arrays(
            [pa.array(out["part"]), *(pa.array(out[k], pa.binary()) for k in ("ids", "keys", "sizes", "hashes"))],
            names=list(out),
        )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, list] = ([], [], [], [])
        n = 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            keys = batch.column(2).to_numpy(zero_copy_only=False)
            for rows, data, offsets, _ in _pieces(batch.column(1), length):
                text, _, _, h = _runs(data, offsets, length, gram)
                order = np.lexsort((h, text))
                text, h = text[order], h[order]
                fresh = np.append(True, (text[1:] != text[:-1]) | (h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
                text, h = text[fresh], h[fresh]
                for kept, new in zip(held, (ids[rows.start : rows.stop], keys[rows.start : rows.stop], np.bincount(text, minlength=len(rows)), h), strict=True):
                    kept.append(new)
                n += len(h)
            if n >= 2_000_000:
                yield emit(*held)
                held, n = ([], [], [], []), 0
        if n:
            yield emit(*held)

    return task


def _shared_anchors(groups: pa.Table) -> pa.Table:
    """Anchors that two documents have: for each document, the low halves of their hashes.

    Half a hash is enough here, as partitions grow in number with the text: a chance match only sends
    a run that nothing will match.
    """
    docs, keys, hashes, rows = [], [], [], []
    n = 0
    for name in ("ids", "keys", "sizes", "hashes"):
        groups = groups.set_column(groups.schema.get_field_index(name), name, groups[name].combine_chunks())
    for ids, key, sizes, h in zip(*(groups[c].to_pylist() for c in ("ids", "keys", "sizes", "hashes")), strict=True):
        docs.append(np.frombuffer(ids, np.int64))
        keys.append(np.frombuffer(key, np.int64))
        hashes.append(np.frombuffer(h, np.uint32))
        rows.append(np.repeat(np.arange(n, n + len(docs[-1])), np.frombuffer(sizes, np.int32)))
        n += len(docs[-1])
    doc, key, h, row = _joined(docs, np.int64), _joined(keys, np.int64), _joined(hashes, np.uint32), _joined(rows, np.int64)
    order = np.argsort(h, kind="stable")
    sorted_h, own = h[order], doc[row[order]]
    first = np.flatnonzero(np.append(True, sorted_h[1:] != sorted_h[:-1]))
    shared = np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first)
    member = np.empty(len(h), bool)
    member[order] = np.repeat(shared, np.diff(np.append(first, len(h))))
    row, h = row[member], h[member]
    order = np.argsort(row, kind="stable")
    row, low = row[order], h[order]
    names, begin = np.unique(row, return_index=True)
    return pa.table(
        {
            "doc_id": pa.array(doc[names]),
            "text_key": pa.array(key[names]),
            "anchors": pa.array([low[a:b].tobytes() for a, b in zip(begin, np.append(begin, len(low))[1:], strict=True)], pa.binary()),
        }
    )


def _run_rows(length: int, gram: int, parts: int):
    """The bytes of every run around a shared anchor, grouped by the anchor's hash partition."""

    def emit(held: list[tuple]) -> pa.RecordBatch:
        doc, key, start, size, h = (np.concatenate([x[k] for x in held]) for k in range(5))
        flat = np.concatenate([x[5] for x in held])
        at = np.cumsum(size) - size
        part = (h >> np.uint64(32)) % np.uint64(parts)
        order = np.lexsort((h, part))
        names, begin = np.unique(part[order], return_index=True)
        out: dict[str, list] = {k: [] for k in ("ids", "keys", "starts", "sizes", "anchors", "bytes")}
        for a, b in zip(begin, np.append(begin, len(order))[1:], strict=True):
            own = order[a:b]
            total = np.cumsum(size[own])
            index = np.arange(total[-1]) + np.repeat(at[own] - (total - size[own]), size[own])
            for name, values in (("ids", doc[own]), ("keys", key[own]), ("starts", start[own]), ("sizes", size[own].astype(np.int32)), ("anchors", h[own]), ("bytes", flat[index])):
                out[name].append(_pack(values))
        return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), *(pa.array(v, pa.binary()) for v in out.values())], names=["part", *out])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0
        for batch in batches:
            batch = batch.filter(batch.column(3).is_valid())
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            keys = batch.column(2).to_numpy(zero_copy_only=False)
            shared = batch.column(3)
            for rows, data, offsets, base in _pieces(batch.column(1), length):
                text, begin, count, h = _runs(data, offsets, length, gram)
                low = h.astype(np.uint32)
                cuts = np.searchsorted(text, np.arange(len(rows) + 1))
                keep = np.zeros(len(h), bool)
                for i in range(len(rows)):
                    own = np.frombuffer(b"".join(shared[rows.start + i].as_py()), np.uint32)
                    keep[cuts[i] : cuts[i + 1]] = np.isin(low[cuts[i] : cuts[i + 1]], own)
                text, begin, count, h = text[keep], begin[keep], count[keep], h[keep]
                if not len(h):
                    continue
                size = count + (length - 1)
                total = np.cumsum(size)
                flat = data[np.arange(total[-1]) + np.repeat(begin - (total - size), size)]
                held.append((ids[rows.start + text], keys[rows.start + text], begin - offsets[:-1][text] + base, size, h, flat))
                n += len(flat)
            if n >= 16 << 20:
                yield emit(held)
                held, n = [], 0
        if held:
            yield emit(held)

    return task


def _covered(length: int):
    """The byte ranges of each document that an earlier document has, from one partition's runs."""

    def groups(table: pa.Table) -> pa.Table:
        def column(name: str, kind: type) -> np.ndarray:
            return _joined([_unpack(x, kind) for x in table[name].to_pylist()], kind)

        doc, key, start, anchor = column("ids", np.int64), column("keys", np.int64), column("starts", np.int64), column("anchors", np.uint64)
        size, flat = column("sizes", np.int32).astype(np.int64), column("bytes", np.uint8)
        at = np.cumsum(size) - size
        # Equal runs are one; all but the first document's are covered whole.
        run = _run_hashes(flat, at, size)
        order = np.lexsort((doc, run))
        fresh = np.append(True, run[order][1:] != run[order][:-1])
        first = order[fresh]
        least = np.empty(len(doc), np.int64)
        least[order] = np.repeat(doc[first], np.diff(np.append(np.flatnonzero(fresh), len(order))))
        whole = least < doc
        docs, keys = [doc[whole]], [key[whole]]
        starts, ends = [start[whole]], [start[whole] + size[whole]]
        # Distinct runs around one anchor may still share windows at their edges.
        _, inverse, seen = np.unique(anchor[first], return_inverse=True, return_counts=True)
        edge = first[seen[inverse] > 1]
        edge = edge[np.argsort(doc[edge], kind="stable")]
        # Every occurrence in the first document counts: it is covered where an earlier one has the window.
        again = np.flatnonzero(~whole)
        family = SuffixFamily(length)
        batches = []
        windows = size[edge] - length + 1
        cut = np.flatnonzero(np.diff(np.cumsum(windows) // BATCH_SUFFIXES)) + 1 if len(edge) else np.zeros(0, np.int64)
        best_of: dict[int, np.ndarray] = {}
        for part in np.split(edge, cut):
            if not len(part):
                continue
            n = size[part] - length + 1
            total = np.cumsum(n)
            where = np.arange(total[-1]) + np.repeat(at[part] - (total - n), n)
            best = family.add(_strings(flat, where, length), np.repeat(doc[part], n))
            batches.append((part, best, total))
        for part, best, total in batches:
            for k, i in enumerate(part):
                best_of[int(run[i])] = best[total[k] - (size[i] - length + 1) : total[k]]
        if best_of:
            names = np.fromiter(best_of, np.uint64, len(best_of))
            for i in again[np.isin(run[again], names)]:
                hit = best_of[int(run[i])] < doc[i]
                if hit.any():
                    turn = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                    begin, end = turn[::2], turn[1::2]
                    docs.append(np.full(len(begin), doc[i]))
                    keys.append(np.full(len(begin), key[i]))
                    starts.append(start[i] + begin)
                    ends.append(start[i] + end + length - 1)
        doc, key = np.concatenate(docs), np.concatenate(keys)
        start, end = np.concatenate(starts), np.concatenate(ends)
        order = np.lexsort((start, key, doc))
        doc, key, start, end = doc[order], key[order], start[order], end[order]
        begin = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))) if len(doc) else np.zeros(0, np.int64)
        cuts = list(zip(begin, np.append(begin, len(doc))[1:], strict=True)) if len(doc) else []
        return pa.table(
            {
                "doc_id": pa.array(doc[begin]),
                "text_key": pa.array(key[begin]),
                "spans": pa.array([np.stack([start[a:b], end[a:b]], axis=1).tobytes() for a, b in cuts], pa.binary()),
            }
        )

    return groups


def merged_spans(spans: np.ndarray) -> np.ndarray:
    """Half-open ranges, sorted, with overlapping and touching ones made one."""
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    fresh = np.append(True, spans[1:, 0] > reach[:-1])
    last = np.append(np.flatnonzero(fresh)[1:] - 1, len(spans) - 1)
    return np.stack([spans[fresh, 0], reach[last]], axis=1)


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        sizes, removed, counts, kept, shas, ranges = [], [], [], [], [], []
        for i, (found, whole) in enumerate(zip(batch.column(2), batch.column(3).to_pylist(), strict=True)):
            own = data[offsets[i] : offsets[i + 1]]
            blobs = found.as_py() or []
            spans = merged_spans(np.concatenate([np.frombuffer(b, np.int64).reshape(-1, 2) for b in blobs]) if blobs else np.zeros((0, 2), np.int64))
            if whole:
                spans = np.array([[0, len(own)]])
            if len(spans):
                keep = np.ones(len(own), bool)
                for a, b in spans:
                    keep[a:b] = False
                rest = own[keep].tobytes()
            else:
                rest = own.tobytes()
            sizes.append(len(own))
            removed.append(len(own) - len(rest))
            counts.append(len(spans))
            kept.append(rest)
            shas.append(hashlib.sha256(rest).hexdigest())
            ranges.append(spans.tolist())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(sizes, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(counts, pa.int64()),
                pa.array(shas, pa.string()),
                pa.array(ranges, pa.list_(pa.list_(pa.int64()))),
                pa.array(kept, pa.binary()),
                batch.column(4),
            ],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept", "text_key"],
        )


def remove_repeats(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept,
    text_key (``xxhash64`` of the text, which tells texts that share an id apart).

    A text is its UTF-8 bytes; null counts as empty. A byte is removed when a string of ``length``
    bytes that covers it also starts in a document with a smaller id; overlaps count and all strings
    are judged on the input. ``spans`` are the maximal removed ranges [start, end), ``kept`` the
    remaining bytes (they may cut a character), ``kept_sha256`` their digest.

    Texts shorter than ``length`` keep all bytes. A null id is never smaller than another and has no
    smaller one, so such rows keep all bytes. Repeated rows keep all bytes between themselves. Other
    columns are not read.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("text_key", F.xxhash64("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(max(24, total // PARTITION_BYTES))
    tasks = min(parts, MOST_TASKS)
    usable = docs.where(f"doc_id is not null and octet_length(text) >= {length}")
    anchors = usable.mapInArrow(_anchor_rows(length, gram, parts), "part long, ids binary, keys binary, sizes binary, hashes binary")
    shared = (
        anchors.repartition(tasks, "part")
        .groupBy("part")
        .applyInArrow(_shared_anchors, "doc_id long, text_key long, anchors binary")
        .groupBy("doc_id", "text_key")
        .agg(F.collect_list("anchors").alias("anchors"))
    )
    # Of equal texts only the first one's runs travel; the others go whole.
    content = usable.select("doc_id", "text_key", F.md5(F.col("text").cast("binary")).alias("digest"), F.octet_length("text").alias("n"))
    firsts = content.groupBy("digest", "n").agg(F.min("doc_id").alias("first"))
    copies = checkpointed(content.join(firsts, ["digest", "n"]).where("doc_id <> first").select("doc_id", "text_key").distinct())
    shared = shared.join(copies, ["doc_id", "text_key"], "left_anti")
    text_side = docs.select("doc_id", "text", "text_key")
    runs = text_side.join(shared, ["doc_id", "text_key"], "left").select("doc_id", "text", "text_key", "anchors")
    runs = runs.mapInArrow(_run_rows(length, gram, parts), "part long, ids binary, keys binary, starts binary, sizes binary, anchors binary, bytes binary")
    spans = (
        runs.repartition(tasks, "part")
        .groupBy("part")
        .applyInArrow(_covered(length), "doc_id long, text_key long, spans binary")
        .groupBy("doc_id", "text_key")
        .agg(F.collect_list("spans").alias("spans"))
    )
    spans = spans.withColumn("whole", F.lit(False)).unionByName(copies.select("*", F.array().cast("array<binary>").alias("spans"), F.lit(True).alias("whole")))
    joined = text_side.join(spans, ["doc_id", "text_key"], "left").select("doc_id", "text", "spans", "whole", "text_key")
    return joined.mapInArrow(
        _cut_texts,
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>, kept binary, text_key long",
    )

"""Language-model scoring with a Brown class-based bigram model.

P(text) is the product of P(class | class before) and P(word | class). Exchange clustering assigns
types to classes: each type moves to the class where the likelihood of class bigrams gains most.
Clustered types are all training words seen ``LEAST`` times or more, whose number grows with the corpus,
and the endings of all others; word counts cover every training word.

Bigrams of types are counted once, in one scan, and kept by type. The ``VOCABULARY`` most frequent words and
the endings are exchanged first, one at a time until none moves. Then all types move in parallel passes
over the bigrams: each type sums the classes beside it and moves against the class bigrams of the pass
before. A pass that doesn't raise the likelihood is undone and fewer types move at once from then on; the
passes end when none moves, or when all types have had their turn and the gain stays below ``GAIN``. The table
is kept by turn, so a pass reads the bigrams of the types whose turn it is, and class bigrams are changed by
those of the types that moved. Words and classes (10 bytes a word) go to every task.

Frequent words have their counts where the classes are; occurrences of the others, of which each word has
fewer than ``LEAST`` in training, are joined with the table of counts.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.storage import checkpointed
from colloquy.llm.blocks import Block, blocks, mix, prefix_sums, span_hash, word_bounds

__all__ = ["exchange_clusters", "score_texts"]

VOCABULARY = 1_000
CLASSES = 48
#: Least training count of a word that is clustered itself.
LEAST = 10
#: Least gain of the passes over all types, in nats for each token.
GAIN = 1e-4
#: Of how many types at most one moves in a pass, when passes with more lower the likelihood.
SPREAD = 16
#: Counts that a task holds before it passes them on.
HELD = 4_000_000
#: Endings (last two bytes of a word, hashed) for words outside the vocabulary.
ENDINGS = 251
#: Bigrams, in either direction, of one part of the bigram table.
PART_PAIRS = 2_000_000


def _words(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, ending and text of every word, A-Z lower-cased."""
    start, end, doc = word_bounds(block)
    sums = prefix_sums(block.data, fold=True)
    endings = (span_hash(sums, np.maximum(end - 2, start), end) >> np.uint64(24)) % np.uint64(ENDINGS)
    return span_hash(sums, start, end), endings.astype(np.int16), doc


def xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def exchange_clusters(pairs: np.ndarray, classes: int, passes: int | None = None) -> np.ndarray:
    """Classes of types from a (types, types) matrix of bigram counts, by the exchange algorithm.

    Starts with types dealt by frequency, then moves one type at a time to the class that raises the
    sum of n log n over class bigrams less that over both margins; ties go to the class it is in, then
    to the lowest. Every move raises the sum, so without a limit of ``passes`` it ends when none moves.
    """
    n_types = len(pairs)
    pairs = pairs.astype(np.float64)
    rows, cols = pairs.sum(axis=1), pairs.sum(axis=0)
    frequent = np.argsort(-(rows + cols), kind="stable")
    classes = min(classes, n_types)
    member = np.empty(n_types, np.int64)
    member[frequent] = np.arange(n_types) % classes
    hot = np.zeros((n_types, classes))
    hot[np.arange(n_types), member] = 1.0
    grid = hot.T @ pairs @ hot
    left, right = grid.sum(axis=1), grid.sum(axis=0)
    to_class, from_class = pairs @ hot, (hot.T @ pairs).T

    for _ in itertools.count() if passes is None else range(passes):
        moved = 0
        for t in frequent:
            if rows[t] + cols[t] == 0:
                continue
            own, self_pair = member[t], pairs[t, t]
            out, into = to_class[t].copy(), from_class[t].copy()
            out[own] -= self_pair
            into[own] -= self_pair
            # Take the type out of its class.
            grid[own] -= to_class[t]
            grid[:, own] -= from_class[t]
            grid[own, own] += self_pair
            left[own] -= rows[t]
            right[own] -= cols[t]
            # Gain of each class: its row gets `out`, its column `into`, its diagonal both and the self pair.
            base = xlogx(grid)
            gain = (xlogx(grid + out) - base).sum(axis=1) + (xlogx(grid.T + into) - base.T).sum(axis=1)
            d = np.diagonal(grid)
            gain += xlogx(d + out + into + self_pair) - xlogx(d + out) - xlogx(d + into) + xlogx(d)
            gain -= xlogx(left + rows[t]) - xlogx(left) + xlogx(right + cols[t]) - xlogx(right)
            best = int(gain.argmax())
            if gain[own] >= gain[best] - 1e-9:
                best = own
            grid[best] += out
            grid[:, best] += into
            grid[best, best] += self_pair
            left[best] += rows[t]
            right[best] += cols[t]
            if best != own:
                moved += 1
                member[t] = best
                to_class[:, own] -= pairs[:, t]
                to_class[:, best] += pairs[:, t]
                from_class[:, own] -= pairs[t]
                from_class[:, best] += pairs[t]
        if not moved:
            break
    return member


@dataclass
class _Types:
    """Clustered types: sorted hashes of words, then endings, then the end of a text."""

    hashes: np.ndarray

    @property
    def count(self) -> int:
        return len(self.hashes) + ENDINGS + 1

    def of(self, words: np.ndarray, endings: np.ndarray) -> np.ndarray:
        out = len(self.hashes) + endings.astype(np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
            known = self.hashes[at] == words
            out[known] = at[known]
        return out

    def chains(self, types: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bigrams (before, after, text) of every text; the end stands before the first word too."""
        end = self.count - 1
        sizes = np.bincount(doc, minlength=n) + 1
        stop = np.cumsum(sizes) - 1
        after = np.full(sizes.sum(), end, np.int64)
        inside = np.ones(len(after), bool)
        inside[stop] = False
        after[inside] = types
        before = np.empty_like(after)
        before[1:] = after[:-1]
        before[:1] = end
        return before, after, np.repeat(np.arange(n), sizes)


def _merged(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, with the sums of their counts and, for any more columns, a value of each."""
    keys, counts, *more = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    summed = np.add.reduceat(counts[order], first) if len(first) else counts
    return keys[first], summed, *(x[order[first]] for x in more)


def _counting(of_block, names: tuple[str, ...]):
    """A task that counts what ``of_block`` finds (keys, counts, ..) and passes partial counts on."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for block in blocks(batch.column(0)):
                held.append(of_block(block))
                if sum(len(x[0]) for x in held) >= HELD:
                    held = [_merged(held)]
                    if len(held[0][0]) >= HELD // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=names)
                        held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _merged(held)], names=names)

    return task


def _word_counts(texts: DataFrame) -> DataFrame:
    """Columns word, total, ending of every distinct word of ``texts`` (text)."""

    def of_block(block: Block) -> tuple[np.ndarray, ...]:
        word, ending, _ = _words(block)
        names, first, n = np.unique(word, return_index=True, return_counts=True)
        return names.view(np.int64), n, ending[first].astype(np.int32)

    rows = texts.mapInArrow(_counting(of_block, ("word", "n", "ending")), "word long, n long, ending int")
    return checkpointed(rows.groupBy("word").agg(F.sum("n").alias("total"), F.first("ending").alias("ending")))


@dataclass
class _ClassModel:
    """Classes of types and log10 probabilities; it grows with the words seen ``LEAST`` times."""

    types: _Types
    member: np.ndarray
    transitions: np.ndarray
    sizes: np.ndarray
    word_logs: np.ndarray
    tokens: int
    distinct: int


def _pack(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), "zstd", asbytes=True)


def _unpack(blob: bytes, kind: type, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind)


def _by_type(types: np.ndarray, codes: np.ndarray, n: np.ndarray, narrow: type) -> dict[str, list]:
    """Bigrams in the order of their types as one row: the types, how many bigrams each has, codes and counts."""
    kinds, sizes = np.unique(types, return_counts=True)
    least = np.min_scalar_type(int(n.max(initial=0)))
    values = {"type": kinds.astype(narrow), "size": sizes.astype(np.int64), "code": codes.astype(narrow), "count": n.astype(least)}
    return {"n_types": [len(kinds)], "n": [len(codes)], "width": [least.itemsize]} | {c: [_pack(v)] for c, v in values.items()}


_PACKED = "n_types long, n long, width long, type binary, size binary, code binary, count binary"


def _turns(types: np.ndarray, spread: int) -> np.ndarray:
    return mix(types.astype(np.uint64)) % np.uint64(spread)


def _bigrams(texts: DataFrame, types: _Types, tokens: int) -> DataFrame:
    """Bigrams of types by part and turn: each row holds some types, with all bigrams of each one after another.

    A code is the type after, or ``types.count`` + the type before. A task counts, deals its counts out to
    parts by type, for either side of a bigram, and sends each part as one packed row; the counts of a part
    meet once. There are parts enough that none meets more than twice PART_PAIRS, were no bigram repeated.
    """
    n_types, parts = types.count, max(24, -(-tokens // PART_PAIRS))
    narrow, step = _narrow(n_types), -(-parts // 8)

    def of_block(block: Block) -> tuple[np.ndarray, ...]:
        word, ending, doc = _words(block)
        before, after, _ = types.chains(types.of(word, ending), doc, len(block))
        return np.unique(before * n_types + after, return_counts=True)

    def dealt(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for backwards in (False, True):
            kinds = keys % n_types if backwards else keys // n_types
            parts_of = (mix(kinds.astype(np.uint64)) % np.uint64(parts)).astype(np.int32)
            # Some parts at a time, so what is sorted and copied stays a fraction of the counts held.
            for some in range(0, parts, step):
                at = np.flatnonzero((parts_of >= some) & (parts_of < some + step))
                kind, part, n = kinds[at], parts_of[at], counts[at]
                code = keys[at] // n_types + n_types if backwards else keys[at] % n_types
                order = np.lexsort((code, kind, part))
                kind, code, n, part = kind[order], code[order], n[order], part[order]
                cuts = np.searchsorted(part, np.arange(some, min(some + step, parts) + 1))
                for k, (low, high) in enumerate(zip(cuts[:-1], cuts[1:], strict=True), some):
                    if high > low:
                        yield pa.RecordBatch.from_pydict({"part": [k]} | _by_type(kind[low:high], code[low:high], n[low:high], narrow))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for block in blocks(batch.column(0)):
                held.append(of_block(block))
                if sum(len(x[0]) for x in held) >= HELD:
                    held = [_merged(held)]
                    if len(held[0][0]) >= HELD // 2:
                        yield from dealt(*held[0])
                        held = []
        if held:
            yield from dealt(*_merged(held))

    def met(table: pa.Table) -> pa.Table:
        held = []
        for row in table.to_pylist():
            kinds, sizes, code, n = _part(row, narrow)
            held.append((np.repeat(kinds.astype(np.int64) * (2 * n_types), sizes) + code, n.astype(np.int64)))
        keys, sums = _merged(held)
        kinds, code = keys // (2 * n_types), keys % (2 * n_types)
        turns = _turns(kinds, SPREAD).astype(np.uint8)
        order = np.argsort(turns, kind="stable")
        cuts = np.searchsorted(turns[order], np.arange(SPREAD + 1))
        own = [order[low:high] for low, high in zip(cuts[:-1], cuts[1:], strict=True)]
        rows = [{"turn": [turn]} | _by_type(kinds[at], code[at], sums[at], narrow) for turn, at in enumerate(own) if len(at)]
        return pa.Table.from_pydict({c: [x for row in rows for x in row[c]] for c in rows[0]})

    rows = texts.mapInArrow(count, f"part long, {_PACKED}")
    # Passes stream rows, so two parts are one task of theirs.
    return checkpointed(rows.repartition(parts, "part").groupBy("part").applyInArrow(met, f"turn long, {_PACKED}")).coalesce(-(-parts // 2))


def _of_turn(bigrams: DataFrame, turn: int, spread: int) -> DataFrame:
    """Rows with the types whose turn it is, and others only where ``spread`` doesn't divide ``SPREAD``."""
    return bigrams if SPREAD % spread else bigrams.where(F.col("turn") % spread == turn % spread)


def _narrow(n_types: int) -> type:
    return np.int32 if 2 * n_types < 2**31 else np.int64


def _part(row: dict, narrow: type) -> tuple[np.ndarray, ...]:
    """Types, how many bigrams each has, and the codes and counts of these."""
    wanted = (("type", narrow, "n_types"), ("size", np.int64, "n_types"), ("code", narrow, "n"), ("count", np.dtype(f"u{row['width']}"), "n"))
    return tuple(_unpack(row[c], kind, row[n]) for c, kind, n in wanted)


def _mapped(bigrams: DataFrame, group: np.ndarray, n_groups: int) -> np.ndarray:
    """The matrix of bigram counts after each type is replaced by its group."""
    n_types = len(group)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = np.zeros(n_groups * n_groups, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                kinds, sizes, code, n = _part(row, _narrow(n_types))
                after = code < n_types
                cell = np.repeat(group[kinds].astype(np.int64) * n_groups, sizes)[after] + group[code[after]]
                grid += np.bincount(cell, weights=n[after], minlength=len(grid)).astype(np.int64)
        found = np.flatnonzero(grid)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(grid[found])], names=["cell", "n"])

    cells = bigrams.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n_groups * n_groups)
    out[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    return out.reshape(n_groups, n_groups)


def _shifted(bigrams: DataFrame, member: np.ndarray, grid: np.ndarray, moved: np.ndarray, turn: int, spread: int) -> np.ndarray:
    """``grid``, the class bigrams of ``member``, as it is for ``moved``, where types moved whose turn it was."""
    n_classes, n_types = len(grid), len(member)
    gone = member != moved

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = np.zeros(n_classes * n_classes)
        for batch in batches:
            for row in batch.to_pylist():
                own, sizes, code, n = _part(row, _narrow(n_types))
                go = gone[own]
                if not go.any():
                    continue
                own, at = np.repeat(own[go], sizes[go]), np.repeat(go, sizes)
                code, n = code[at], n[at]
                backwards = code >= n_types
                other = np.where(backwards, code - n_types, code)
                # A bigram of two types that moved counts with its first.
                once = ~(backwards & gone[other])
                own, other, backwards, n = own[once], other[once], backwards[once], n[once]
                first, last = np.where(backwards, other, own), np.where(backwards, own, other)
                for classes, sign in ((member, -1), (moved, 1)):
                    cell = classes[first].astype(np.int64) * n_classes + classes[last]
                    change += sign * np.bincount(cell, weights=n, minlength=len(change))
        found = np.flatnonzero(change)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(change[found].astype(np.int64))], names=["cell", "n"])

    cells = _of_turn(bigrams, turn, spread).mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = grid.ravel().copy()
    out[cells["cell"].to_numpy()] += cells["n"].to_numpy()
    return out.reshape(n_classes, n_classes)


def _moves(bigrams: DataFrame, member: np.ndarray, grid: np.ndarray, turn: int, spread: int) -> tuple[np.ndarray, np.ndarray]:
    """Types whose turn it is that gain by another class, and that class; the last class is the end's.

    The gain is that in likelihood if the type moved alone.
    """
    n_classes = len(grid)
    wide, n_types = 2 * n_classes, len(member)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = grid.sum(axis=1), grid.sum(axis=0)
        # Column k of both: the counts that a context of code k adds to, by class of the type.
        cells = np.concatenate([grid, grid.T], axis=1)
        beside_of = np.concatenate([member, member + n_classes])
        for batch in batches:
            for row in batch.to_pylist():
                own, sizes, code, count = _part(row, _narrow(n_types))
                turns = (_turns(own, spread) == turn % spread) & (own < n_types - 1)
                if not turns.all():
                    mine = np.repeat(turns, sizes)
                    own, sizes, code, count = own[turns], sizes[turns], code[mine], count[mine]
                beside = beside_of[code]
                ends = np.cumsum(sizes)
                for at in range(0, len(own), 4096):
                    kinds, size = own[at : at + 4096], sizes[at : at + 4096]
                    low, high = ends[at] - size[0], ends[at + len(kinds) - 1]
                    place = np.repeat(np.arange(len(kinds)) * wide, size)
                    dense = np.bincount(place + beside[low:high], weights=count[low:high], minlength=len(kinds) * wide)
                    # Bigrams of a type with itself go where the type goes.
                    twice = np.bincount(np.repeat(np.arange(len(kinds)), size), weights=count[low:high] * (code[low:high] == np.repeat(kinds, size)), minlength=len(kinds))
                    cls, at_type = member[kinds], np.arange(len(kinds))
                    dense = dense.reshape(-1, wide)
                    totals = dense[:, :n_classes].sum(axis=1), dense[:, n_classes:].sum(axis=1)
                    dense[at_type, cls] -= twice
                    dense[at_type, n_classes + cls] -= twice
                    out, into = dense[:, :n_classes], dense[:, n_classes:]
                    dense = dense.ravel()
                    names = np.flatnonzero(dense)
                    context, n = names % wide, dense[names]
                    first = np.searchsorted(names, np.arange(len(kinds)) * wide)
                    each = np.repeat(cls, np.diff(np.append(first, len(names))))
                    # Few (count, context) differ, so the logs are taken once for each.
                    pair, which = np.unique(n.astype(np.int64) * wide + context, return_inverse=True)
                    cell = cells[:, pair % wide].T
                    step = (xlogx(cell + (pair // wide)[:, None]) - xlogx(cell))[which]
                    inside = cells[each, context]
                    step[np.arange(len(each)), each] = xlogx(inside) - xlogx(inside - n)
                    gain = np.add.reduceat(step, first)
                    # So far each cell was changed alone. Two changes meet in the class's cell with itself, and
                    # where it stands beside the class that the type leaves.
                    own_out, own_into = out[at_type, cls], into[at_type, cls]
                    d, after_own, before_own = np.diagonal(grid), grid[cls], grid[:, cls].T
                    change = xlogx(d + out + into + twice[:, None]) - xlogx(d + out) - xlogx(d + into) + xlogx(d)
                    for met, leaves, comes in ((before_own, into, own_out), (after_own, out, own_into)):
                        change += xlogx(met - leaves + comes[:, None]) - xlogx(met - leaves) - xlogx(met + comes[:, None]) + xlogx(met)
                    d = d[cls]
                    change[at_type, cls] = xlogx(d - own_out) + xlogx(d - own_into) - xlogx(d) - xlogx(d - own_out - own_into - twice)
                    gain += change
                    for margin, total in zip((left, right), totals, strict=True):
                        loss = xlogx(margin + total[:, None]) - xlogx(margin)
                        loss[at_type, cls] = xlogx(margin[cls]) - xlogx(margin[cls] - total)
                        gain -= loss
                    # Into a class that is empty all would move at once, like and unlike.
                    gain[:, left + right == 0] = -np.inf
                    gain[:, -1] = -np.inf
                    best = gain.argmax(axis=1)
                    go = gain[at_type, best] > gain[at_type, cls] + 1e-9
                    yield pa.RecordBatch.from_arrays([pa.array(kinds[go].astype(np.int64)), pa.array(best[go])], names=["type", "class"])

    found = _of_turn(bigrams, turn, spread).mapInArrow(task, "type long, class long").toArrow()
    return found["type"].to_numpy(), found["class"].to_numpy()


def _likelihood(grid: np.ndarray) -> float:
    return float(xlogx(grid).sum() - xlogx(grid.sum(axis=1)).sum() - xlogx(grid.sum(axis=0)).sum())


def _exchange_all(bigrams: DataFrame, member: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all types after parallel passes from ``member``, and their class bigrams."""
    best, turn, spread, gained = None, 0, 2, 0.0
    while True:
        grid = _mapped(bigrams, member, n_classes) if best is None else _shifted(bigrams, best[1], best[2], member, turn - 1, spread)
        score = _likelihood(grid)
        if best is None or score > best[0]:
            gained += score - best[0] if best is not None else 0.0
            best = (score, member, grid)
        else:
            spread *= 2
        if spread > SPREAD:
            return best[1], best[2]
        while True:
            if turn and turn % spread == 0:
                if gained <= GAIN * grid.sum():
                    return best[1], best[2]
                gained = 0.0
            kinds, to = _moves(bigrams, best[1], best[2], turn, spread)
            turn += 1
            if len(kinds):
                break
        member = best[1].copy()
        member[kinds] = to


def _fit(texts: DataFrame, counted: DataFrame, n_ends: int, vocabulary: int, least: int, classes: int, passes: int | None) -> _ClassModel:
    top = counted.orderBy(F.desc("total"), "word").limit(vocabulary).toArrow()
    often = counted.where(F.col("total") >= least).toArrow()
    word, total, end = (np.concatenate([top[c].to_numpy(), often[c].to_numpy()]) for c in ("word", "total", "ending"))
    hashes, first_at = np.unique(word.astype(np.int64).view(np.uint64), return_index=True)
    tokens_of, ending_of = total[first_at].astype(np.float64), end[first_at].astype(np.int64)
    core = np.isin(hashes, top["word"].to_numpy().astype(np.int64).view(np.uint64))
    types = _Types(hashes)
    n_types, n_core = types.count, int(core.sum())
    bigrams = _bigrams(texts, types, int(counted.agg(F.sum("total")).first()[0] or 0) + n_ends)

    # Words outside the core stand under their endings at first.
    group = np.empty(n_types, np.int64)
    group[: len(hashes)] = n_core + ending_of
    group[: len(hashes)][core] = np.arange(n_core)
    group[len(hashes) :] = n_core + np.arange(ENDINGS + 1)
    grid = _mapped(bigrams, group, n_core + ENDINGS + 1)
    # The end of a text is a class of its own.
    own = exchange_clusters(grid[:-1, :-1], classes, passes)
    n_classes = int(own.max()) + 2
    member = np.append(own, n_classes - 1).astype(np.int16)[group]
    member, between = _exchange_all(bigrams, member, n_classes)
    transitions = np.log10((between + 0.5) / (between.sum(axis=1, keepdims=True) + 0.5 * n_classes))
    by_ending = counted.groupBy("ending").agg(F.sum("total").alias("tokens"), F.count("*").alias("words")).toArrow()
    tokens, distinct = np.zeros(n_types), np.zeros(n_types)
    place = len(hashes) + by_ending["ending"].to_numpy()
    tokens[place], distinct[place] = by_ending["tokens"].to_numpy(), by_ending["words"].to_numpy()
    np.subtract.at(tokens, len(hashes) + ending_of, tokens_of)
    np.subtract.at(distinct, len(hashes) + ending_of, 1)
    tokens[: len(hashes)], distinct[: len(hashes)] = tokens_of, 1
    tokens[-1], distinct[-1] = n_ends, n_ends > 0
    class_tokens = np.bincount(member, weights=tokens, minlength=n_classes)
    class_words = np.bincount(member, weights=distinct, minlength=n_classes)
    sizes = np.log10(class_tokens + 0.5 * (class_words + 1))
    return _ClassModel(types, member, transitions, sizes, np.log10(tokens_of + 0.5), int(tokens.sum()), int(distinct.sum()))


def score_texts(
    documents: DataFrame,
    train: str | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: int = VOCABULARY,
    least: int = LEAST,
    classes: int = CLASSES,
    passes: int | None = None,
) -> DataFrame:
    """One row for each document: doc_id, trained, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    ``train`` is a condition on ``documents`` (SQL; all rows if none) that picks the training rows, null
    counting as false. Tokens are the words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, then one end.
    ``base_score`` is the unigram log10 probability with counts raised by a half,
    ``(c + 0.5) / (N + 0.5 * (V + 1))`` for each token; ``score`` that of the class model and
    ``perplexity`` ``10 ** (-score / n_tokens)``. ``n_known`` counts tokens seen in training.

    A null text is empty, its one token the end. Rows with a null or repeated id are scored like others.
    Without training rows every token is unknown. Other columns are not read, but by ``train``.
    """
    docs = documents.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.expr(train) if train else F.lit(True), F.lit(False)).alias("trained"),
    )
    texts = docs.where("trained").select("text")
    n_ends = texts.count()
    counted = _word_counts(texts)
    model = _fit(texts, counted, n_ends, vocabulary, least, classes, passes)
    unknown = float(np.log10(0.5))

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = model.types
        for batch in batches:
            for block in blocks(batch.column(2)):
                word, ending, doc = _words(block)
                kinds = types.of(word, ending)
                before, after, text = types.chains(kinds, doc, len(block))
                logs = model.transitions[model.member[before], model.member[after]] - model.sizes[model.member[after]]
                often = kinds < len(types.hashes)
                seldom = np.bincount(doc[~often], minlength=len(block))
                known = np.bincount(doc[often], weights=model.word_logs[kinds[often]], minlength=len(block))
                rows = (block.rows.start, len(block))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k).slice(*rows) for k in range(2)),
                        pa.array(np.bincount(text, minlength=len(block))),
                        pa.array(np.bincount(doc[often], minlength=len(block))),
                        pa.array(np.bincount(text, weights=logs, minlength=len(block))),
                        pa.array(known + unknown * seldom),
                        pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(seldom)).astype(np.int32)), pa.array(word[~often].view(np.int64))),
                    ],
                    names=["doc_id", "trained", "n_tokens", "n_often", "chain", "words_log", "seldom"],
                )

    scheme = "doc_id long, trained boolean, n_tokens long, n_often long, chain double, words_log double, seldom array<long>"
    # The rows are fixed once written, and so are their numbers.
    scored = checkpointed(docs.select("doc_id", "trained", "text").mapInArrow(chains, scheme)).withColumn("row", F.monotonically_increasing_id())
    found = scored.select("row", F.explode("seldom").alias("word")).join(counted.where(F.col("total") < least).select("word", "total"), "word")
    sums = found.groupBy("row").agg(F.sum(F.log10(F.col("total") + 0.5) - unknown).alias("a"), F.count("*").alias("b"))
    end = F.lit(float(np.log10(n_ends + 0.5)))
    total = F.lit(float(np.log10(model.tokens + 0.5 * (model.distinct + 1))))
    words_log = F.col("words_log") + F.coalesce("a", F.lit(0.0)) + end
    score = F.col("chain") + words_log
    return scored.drop("seldom").join(sums, "row", "left").select(
        "doc_id",
        "trained",
        "n_tokens",
        (F.col("n_often") + F.coalesce("b", F.lit(0)) + int(n_ends > 0)).cast("long").alias("n_known"),
        F.lit(int(model.tokens)).cast("long").alias("train_tokens"),
        (words_log - F.col("n_tokens") * total).alias("base_score"),
        score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )

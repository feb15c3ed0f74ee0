"""Language identification of mixed texts: script ranges, word scores and Viterbi spans.

A language's model is its byte trigrams (hashed to ``SLOTS``) and the scripts its training words are
written in, by ranges of code points. A word's script (of several, the last in ``SCRIPTS``) leaves only the languages written in it; the word's score for each is the
log probability of its trigrams. Viterbi then labels the words so that the sum of scores, less
``SWITCH`` for every change of language, is largest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.blocks import Block, blocks, word_bounds

__all__ = ["LanguageModel", "fit_languages", "identify_languages", "viterbi"]

SLOTS = 1 << 15
SWITCH = 8.0
#: A language is written in a script that has this share of its training words.
SCRIPT_SHARE = 0.02
_FORBIDDEN = -1e4

#: First code points of ranges and their scripts (fixed values of Unicode's blocks); "none" is no letter.
RANGES = (
    (0x0000, "none"), (0x0041, "latin"), (0x005B, "none"), (0x0061, "latin"), (0x007B, "none"), (0x00AA, "latin"), (0x00AB, "none"),
    (0x00B5, "greek"), (0x00B6, "none"), (0x00BA, "latin"), (0x00BB, "none"), (0x00C0, "latin"), (0x00D7, "none"), (0x00D8, "latin"),
    (0x00F7, "none"), (0x00F8, "latin"), (0x02B0, "none"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
    (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0750, "arabic"), (0x0780, "other"), (0x08A0, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"),
    (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"),
    (0x0F00, "tibetan"), (0x1000, "burmese"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"),
    (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1C80, "cyrillic"), (0x1C90, "georgian"), (0x1CC0, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "none"), (0x2C00, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x2D00, "georgian"),
    (0x2D30, "other"), (0x2D80, "ethiopic"), (0x2DE0, "cyrillic"), (0x2E00, "none"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"),
    (0x3190, "none"), (0x31F0, "kana"), (0x3200, "none"), (0x3400, "han"), (0x4DC0, "none"), (0x4E00, "han"), (0xA000, "other"),
    (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "none"), (0xFE70, "arabic"),
    (0xFEFF, "none"), (0xFF21, "latin"), (0xFF3B, "none"), (0xFF41, "latin"), (0xFF5B, "none"), (0xFF66, "kana"), (0xFFA0, "hangul"),
    (0xFFE0, "none"), (0x10000, "other"), (0x1F000, "none"), (0x20000, "han"), (0x40000, "none"),
)
SCRIPTS = tuple(dict.fromkeys(name for _, name in RANGES))
_FROM = np.array([first for first, _ in RANGES], np.uint32)
_NUMBER = np.array([SCRIPTS.index(name) for _, name in RANGES], np.uint8)
_ASCII = _NUMBER[np.searchsorted(_FROM, np.arange(256, dtype=np.uint32), "right") - 1]
_ASCII[128:] = 0


def script_numbers(data: np.ndarray) -> np.ndarray:
    """The script (place in ``SCRIPTS``) of the character that begins at each byte of UTF-8; 0 inside one."""
    out = _ASCII[data]
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead):
        padded = np.append(data, np.zeros(3, np.uint8)).astype(np.uint32)
        b0, b1, b2, b3 = (padded[lead + k] for k in range(4))
        tail1, tail2, tail3 = b1 & 0x3F, b2 & 0x3F, b3 & 0x3F
        two = (b0 & 0x1F) << 6 | tail1
        three = (b0 & 0x0F) << 12 | tail1 << 6 | tail2
        four = (b0 & 0x07) << 18 | tail1 << 12 | tail2 << 6 | tail3
        point = np.where(b0 < 0xE0, two, np.where(b0 < 0xF0, three, four))
        out[lead] = _NUMBER[np.searchsorted(_FROM, point, "right") - 1]
    return out


_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0x20


def word_trigrams(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slot of the trigram around every byte, word starts and ends, texts, and scripts of the words."""
    start, end, doc = word_bounds(block)
    folded = _FOLD[block.data]
    before, after = np.empty_like(folded), np.empty_like(folded)
    before[1:], after[:-1] = folded[:-1], folded[1:]
    before[start], after[end - 1] = 0x20, 0x20
    slot = (before * np.uint32(0x9E3779B1) + folded * np.uint32(0x85EBCA77) + after * np.uint32(0xC2B2AE3D)) >> np.uint32(17)
    letters = script_numbers(block.data)
    script = np.maximum.reduceat(letters, start) if len(start) else np.zeros(0, np.uint8)
    return slot, start, end, doc, script


def viterbi(scores: np.ndarray, counts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of every word; ``scores`` holds texts one after another, ``counts`` their words.

    Ties go to staying, then to the lower label. All texts of a block advance together, longest first,
    so a step is one operation on the texts that still have words.
    """
    out = np.zeros(len(scores), np.int16)
    n_labels = scores.shape[1]
    if n_labels == 1 or not len(scores):
        return out
    order = np.argsort(-counts, kind="stable")
    begin = (np.cumsum(counts) - counts)[order]
    sizes = counts[order]
    longest = int(sizes[0])
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")
    value = scores[begin[: active[0]]].copy() if active[0] else np.zeros((0, n_labels), np.float32)
    came = np.empty((len(scores), n_labels), np.int16)
    stay = np.arange(n_labels, dtype=np.int16)
    final = np.zeros(len(sizes), np.int64)
    for step in range(1, longest):
        n = active[step]
        if n < len(value):
            final[n : len(value)] = value[n:].argmax(axis=1)
            value = value[:n]
        best = value.argmax(axis=1)
        jump = value[np.arange(n), best] - switch
        stays = value >= jump[:, None]
        at = begin[:n] + step
        came[at] = np.where(stays, stay, best[:, None])
        value = np.maximum(value, jump[:, None]) + scores[at]
    final[: len(value)] = value.argmax(axis=1)
    label = final
    for step in range(longest - 1, -1, -1):
        n = active[step]
        at = begin[:n] + step
        out[at] = label[:n]
        if step:
            label[:n] = came[at, label[:n]]
    return out


@dataclass
class LanguageModel:
    """Log probabilities (languages, SLOTS) and allowed scripts (scripts, languages)."""

    languages: list[str]
    trigrams: np.ndarray
    scripts: np.ndarray

    def label(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word starts, ends, texts, labels and scripts of a block."""
        slot, start, end, doc, script = word_trigrams(block)
        if not len(start):
            return start, end, doc, np.zeros(0, np.int16), script
        bounds = np.stack([start, end], axis=1).ravel()
        if bounds[-1] == len(slot):
            bounds = bounds[:-1]
        # By language, so that a block's bytes are held once and not for each language.
        scores = np.stack([np.add.reduceat(logs[slot], bounds)[::2] for logs in self.trigrams], axis=1)
        allowed = self.scripts[script]
        scores = scores + np.where(allowed | ~allowed.any(axis=1, keepdims=True), 0.0, _FORBIDDEN).astype(np.float32)
        scores[script == 0] = 0.0
        return start, end, doc, viterbi(scores, np.bincount(doc, minlength=len(block))), script


def fit_languages(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", slots: int = SLOTS) -> LanguageModel:
    """Trigram and script counts of each language over all rows; rows with a null text or language are left out.

    The model holds ``slots`` numbers for each language, whatever the corpus.
    """
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.asarray(batch.column(0).to_pylist(), dtype=object)
            for block in blocks(batch.column(1)):
                slot, start, end, doc, script = word_trigrams(block)
                inside = np.zeros(len(slot) + 1, np.int64)
                np.add.at(inside, start, 1)
                np.add.at(inside, end, -1)
                inside = np.cumsum(inside[:-1]) > 0
                text = np.searchsorted(block.offsets, np.arange(len(slot)), side="right") - 1
                own = langs[block.rows.start : block.rows.stop]
                for lang in set(own):
                    mine = own == lang
                    grams = np.bincount(slot[inside & mine[text]], minlength=slots)
                    words = np.bincount(script[mine[doc]], minlength=len(SCRIPTS))
                    have = totals.setdefault(lang, np.zeros(slots + len(SCRIPTS), np.int64))
                    have += np.concatenate([grams, words])
        for lang, have in totals.items():
            found = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.astype(np.int32)), pa.array(have[found])], names=["lang", "slot", "n"])

    counts = rows.mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(counts["lang"].to_pylist()))
    table = np.zeros((len(languages), slots + len(SCRIPTS)))
    index = {lang: k for k, lang in enumerate(languages)}
    table[[index[x] for x in counts["lang"].to_pylist()], counts["slot"].to_numpy()] = counts["n"].to_numpy()
    grams, words = table[:, :slots], table[:, slots:]
    logs = np.log((grams + 0.5) / (grams.sum(axis=1, keepdims=True) + 0.5 * slots))
    scripts = words / np.maximum(words[:, 1:].sum(axis=1, keepdims=True), 1) >= SCRIPT_SHARE
    return LanguageModel(languages, logs.astype(np.float32), np.ascontiguousarray(scripts.T))


def identify_languages(documents: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, lang_pred, score, spans (start, end, lang).

    Spans are byte ranges of the UTF-8 text, from a first word's start to a last word's end, in one
    language. ``lang_pred`` has most of the bytes in words with a letter (ties: the first by name) and
    ``score`` is its share. Texts that are null or have no letter (Unicode class L), and all texts when
    nothing was learned, get ``und``, score 0 and no spans. Repeated rows and null ids are judged like
    others.
    """
    text = F.col(text_col).cast("string")
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*model.languages, "und"], pa.string())
        n_langs = len(model.languages)
        for batch in batches:
            letters = batch.column(2).to_numpy(zero_copy_only=False)
            for block in blocks(batch.column(1)):
                known = letters[block.rows.start : block.rows.stop] & (n_langs > 0)
                n = len(block)
                picked, share = np.full(n, n_langs), np.zeros(n)
                spans = pa.array([[]] * n, pa.list_(span))
                if known.any():
                    start, end, doc, labels, script = model.label(block)
                    lettered = script > 0
                    sizes = np.bincount(doc * n_langs + labels, weights=(end - start) * lettered, minlength=n * n_langs).reshape(n, n_langs)
                    best = sizes.argmax(axis=1)
                    picked = np.where(known, best, n_langs)
                    share = np.where(known, sizes[np.arange(n), best] / np.maximum(sizes.sum(axis=1), 1), 0.0)
                    first = np.append(True, (labels[1:] != labels[:-1]) | (doc[1:] != doc[:-1]))
                    first = np.flatnonzero(first)
                    last = np.append(first[1:], len(labels)) - 1
                    keep = known[doc[first]]
                    first, last = first[keep], last[keep]
                    base = block.offsets[doc[first]]
                    flat = pa.StructArray.from_arrays(
                        [pa.array(start[first] - base), pa.array(end[last] - base), names.take(pa.array(labels[first].astype(np.int32)))], fields=list(span)
                    )
                    bounds = np.searchsorted(doc[first], np.arange(n + 1))
                    spans = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.rows.start, n), names.take(pa.array(picked.astype(np.int32))), pa.array(share), spans],
                    names=["doc_id", "lang_pred", "score", "spans"],
                )

    return docs.mapInArrow(label, "doc_id long, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>")

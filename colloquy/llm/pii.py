"""Personal data in texts: rules, and a character tagger that finds what their strict forms miss.

The rules decide first and their spans stay. The tagger (a bidirectional LSTM with CRF transitions) learns
from the rules' spans in a bounded sample of pieces, and from forms planted into those pieces: disguised
at-signs and dots, other separators, national phone numbers. It reads every character of every text in
overlapping windows; what the windows say is reconciled over the whole text, and a span is added only if
it passes its kind's check and touches no span of a rule.

Defined results: a null text is empty; an empty text has no spans; a null id and ids or texts that repeat
are each judged by their own row; an empty table gives an empty one; other columns are not looked at. A
text of any length is read whole, window by window, with some 8 bytes a character at a time.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.blocks import BLOCK_BYTES, blocks
from colloquy.llm.char_tagger import Tagger, decode_windows, symbols, train_tagger

__all__ = ["KINDS", "base_spans", "find_personal_data", "fit_pii", "reconciled"]

#: In the order of results; a kind's tag is its place here plus one.
KINDS = ("email", "ip", "card", "phone")

#: Pieces of text to learn from, at most, and their length in code points.
PIECES, PIECE = 2000, 1000

#: Windows that the tagger learns from, their length, and its passes over batches of them.
LESSONS, LESSON, ROUNDS = 9000, 64, 500

#: Length of a window that is decoded, and how much of it the next one shares. At least one window holds any span of up to OVERLAP characters whole.
WINDOW, OVERLAP = 192, 32

# --- rules -------------------------------------------------------------------------------------------

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]++")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From at-sign to at-sign, so a long run of word characters is read once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        hit = _DOMAIN.match(text, at + 1) if start < at else None
        done = hit.end() if hit else at + 1
        if hit:
            yield start, done
        at = text.find("@", done)


def luhn(digits: str) -> bool:
    """Whether the check digit fits."""
    values = np.frombuffer(digits.encode(), np.uint8).astype(np.int64) - 48
    twice = values[-2::-2] * 2
    return int(values[-1::-2].sum() + np.where(twice > 9, twice - 9, twice).sum()) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and int(part) <= 255)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """What the rules find: (kind's place in KINDS, start, end), ordered by kind and start."""
    out = [(0, a, b) for a, b in _emails(text)]
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


# --- checks of what the tagger finds -------------------------------------------------------------------

_AT, _DOT = r"\s?(?:@|[\[({]at[\])}]|\sat\s)\s?", r"\s?(?:\.|[\[({](?:dot|\.)[\])}]|\sdot\s)\s?"
_EMAIL_FORM = re.compile(rf"[A-Za-z0-9._%+-]+{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+", re.I)
_IP_FORM = re.compile(rf"[0-9]+(?:{_DOT}[0-9]+){{3}}", re.I)
_CARD_FORM = re.compile(r"[0-9]+(?:[ ./_ -]{1,2}[0-9]+)*")
_PHONE_FORM = re.compile(r"(?:\+|00|\()?[0-9]+(?:[ ()./ -]{1,2}[0-9]+){1,6}")
_EDGES = " \t\n\r\x0b\x0c.,;:!?\"'<>#$%&*|"


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """The span without white space and punctuation that frames it."""
    while start < end and text[start] in _EDGES:
        start += 1
    while end > start and text[end - 1] in _EDGES:
        end -= 1
    return start, end


def passes(kind: int, found: str) -> bool:
    """Whether a span that the tagger found can be of its kind at all."""
    if len(found) > 254:
        return False
    digits = _NOT_DIGIT.sub("", found)
    if kind == 0:
        return _EMAIL_FORM.fullmatch(found) is not None
    if kind == 1:
        return _IP_FORM.fullmatch(found) is not None and all(map(_small, re.findall("[0-9]+", found)))
    if kind == 2:
        return _CARD_FORM.fullmatch(found) is not None and 13 <= len(digits) <= 19 and luhn(digits)
    return _PHONE_FORM.fullmatch(found) is not None and 10 <= len(digits) <= 15


# --- lessons -----------------------------------------------------------------------------------------


def _digits(rng: np.random.Generator, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _word(rng: np.random.Generator) -> str:
    return "".join(rng.choice(list("aeinorstlumdcphg"), rng.integers(2, 9)))


def _card_number(rng: np.random.Generator, n: int) -> str:
    body = str(rng.integers(2, 7)) + _digits(rng, n - 2)
    return next(body + str(d) for d in range(10) if luhn(body + str(d)))


def planted_span(rng: np.random.Generator, kind: int) -> str:
    """A made-up span of a kind, half of the time in a form that the rules don't know."""
    odd = rng.random() < 0.5
    if kind == 0:
        at = rng.choice([" (at) ", "(at)", "[at]", " [at] ", " at ", " @ "]) if odd else "@"
        dot = rng.choice([".", "(dot)", "[dot]", " dot ", "[.]"]) if odd else "."
        local = rng.choice([".", "_", "-", ""]).join(_word(rng) for _ in range(rng.integers(1, 3)))
        local += rng.choice(["", f".{_digits(rng, 2)}", _digits(rng, 2)])
        host = rng.choice(["", _digits(rng, 1)])
        return local + at + _word(rng) + host + dot + rng.choice([_word(rng) + dot, ""]) + rng.choice(["com", "net", "org", "fr", "de", "es"])
    if kind == 1:
        return (rng.choice(["[.]", " . ", "(.)", "[dot]"]) if odd else ".").join(str(rng.integers(0, 256)) for _ in range(4))
    if kind == 2:
        digits = _card_number(rng, int(rng.choice([13, 15, 16, 19])) if odd else 16)
        gap = rng.choice([".", "  ", "/", "_", ""]) if odd else rng.choice(["", "", " ", "-"])
        return gap.join(digits[k : k + 4] for k in range(0, len(digits), 4))
    area, first, last = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    if odd:
        return str(rng.choice([f"({area}) {first}-{last}", f"{area}-{first}-{last}", f"{area}.{first}.{last}", f"{area} {first} {last}", f"00{area[:2]} {first} {last} {area}", f"({area}) {first} {last}", f"{area}/{first}-{last}"]))
    return str(rng.choice([f"+{area[0]} ({first}) {first}-{last}", f"+{area[:2]} {first} {last}", f"+{area[0]}-{first}-{area}-{last}", f"+{area}{first}{last}"]))


def _lookalike(rng: np.random.Generator) -> str:
    """Digits and signs that are no personal data."""
    d = lambda n: _digits(rng, n)
    hexes = "".join(rng.choice(list("0123456789abcdef"), rng.integers(20, 41)))
    forms = [d(1), d(2), d(4), d(5), d(7), f"{d(1)}.{d(1)}.", f"{d(1)}.{d(2)}", f"{d(1)}.{d(1)}.{d(1)}", f"{d(4)}-{d(2)}-{d(2)}", f"{d(2)}/{d(2)}/{d(4)}", f"{d(2)}:{d(2)}", f"{d(2)}:{d(2)}:{d(2)}"]
    forms += [f"${d(3)}.{d(2)}", f"{d(2)},{d(3)},{d(3)}", f"#{d(6)}", f"@{_word(rng)}", f"{_word(rng)}{d(2)}", hexes, f'"{hexes}"', f"{d(4)}-{d(4)}", f"({d(2)})", f"{d(2)}%", f"v{d(1)}.{d(1)}", f"at {_word(rng)} dot", f"{_word(rng)}.{_word(rng)}", f"{d(30)}", f"{d(3)} {d(2)}", f"+{d(2)}"]
    return str(rng.choice(forms))


def lessons(pieces: list[str], n: int = LESSONS, width: int = LESSON, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Windows of symbols and their tags: as they stand, around a rule's span, or with something planted."""
    rng = np.random.default_rng(seed)
    pieces = [p for p in pieces if p.strip()] or ["la the of und que. " * 8]
    found = [(i, k, a, b) for i, p in enumerate(pieces) for k, a, b in base_spans(p)]
    windows, tags = np.zeros((n, width), np.uint8), np.zeros((n, width), np.int64)
    for row in range(n):
        what = rng.random()
        if found and what < 0.25:
            i, _, a, b = found[rng.integers(len(found))]
            text, at = pieces[i], max(0, a - int(rng.integers(0, max(1, width - (b - a)))))
        else:
            text = pieces[rng.integers(len(pieces))]
            at = int(rng.integers(0, max(1, len(text) - width)))
        body = text[at : at + width]
        marks = np.zeros(width, np.int64)
        if what < 0.45:
            for k, a, b in base_spans(text):
                marks[max(0, a - at) : max(0, b - at)] = k + 1
        else:
            body = "".join(" " if any(c in "0123456789@" for c in body) and c in "0123456789@" else c for c in body)
            parts, spans, size = [], [], 0
            for word in body.split(" "):
                if rng.random() < 0.12 and size < width - 8:
                    kind = int(rng.integers(0, 4)) if rng.random() < 0.6 else -1
                    new = planted_span(rng, kind) if kind >= 0 else _lookalike(rng)
                    spans.append((kind + 1, size, size + len(new)))
                    new += str(rng.choice(["", "", ".", ",", "!!", "%%%", "###"])) + " "
                    parts.append(new)
                    size += len(new)
                parts.append(word + " ")
                size += len(word) + 1
            body = "".join(parts)[:width]
            for tag, a, b in spans:
                marks[a:b] = tag
        body = body.ljust(width, "\n")
        windows[row], tags[row] = symbols(body), marks
    return windows, tags


def fit_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", pieces: int = PIECES, rounds: int = ROUNDS) -> Tagger:
    """A tagger from at most ``pieces`` pieces of PIECE code points, of the documents whose id hashes least.

    What reaches the driver is bounded by that: one number, then the pieces. Of an id that repeats one piece is taken.
    """
    key = F.xxhash64(F.lit("pii"), F.col(id_col))
    cut = docs.select(key.alias("key")).orderBy("key").limit(pieces).agg(F.max("key")).first()[0]
    if cut is None:
        return train_tagger(*lessons([]), len(KINDS) + 1, rounds=rounds)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    some = docs.select(key.alias("key"), text.alias("text")).where(F.col("key") <= cut)
    place = F.pmod(F.hash("key"), F.greatest(F.length("text") - PIECE, F.lit(0)) + 1) + 1
    some = some.select("key", F.substring("text", place, F.lit(PIECE)).alias("piece")).groupBy("key").agg(F.min("piece").alias("piece"))
    rows = some.orderBy("key", "piece").limit(pieces).collect()
    return train_tagger(*lessons([r["piece"] for r in rows]), len(KINDS) + 1, rounds=rounds)


# --- whole texts -------------------------------------------------------------------------------------


def window_bounds(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start in it and length of each window; the last one of a text ends with it."""
    step = WINDOW - OVERLAP
    n = np.where(sizes == 0, 0, np.maximum(1, -(-(sizes - OVERLAP) // step)))
    text = np.repeat(np.arange(len(sizes)), n)
    start = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * step
    return text, start, np.minimum(WINDOW, sizes[text] - start)


def reconciled(found: list[tuple[int, int, int, float, bool, bool]]) -> list[tuple[int, int, int]]:
    """Of one text's runs (start, end, tag, score, cut at the left, cut at the right) those to keep: (tag, start, end).

    A run that its window cuts off goes on in runs of its tag that meet it; runs seen by two windows alike
    add their scores. Of what overlaps then, the choice of greatest total score over the whole text is kept;
    of equal ones that which ends first.
    """
    joined: list[list] = []
    for start, end, tag, score, left, right in sorted(found):
        for old in reversed(joined[-4:]):
            if old[2] == tag and old[1] >= start and (old[5] or left) and old[0] <= start:
                old[1], old[3] = max(old[1], end), old[3] + score
                old[5] = right if end >= old[1] else old[5]
                break
            if old[:3] == [start, end, tag]:
                old[3] += score
                break
        else:
            joined.append([start, end, tag, score, left, right])
    spans = sorted((r for r in joined if r[3] > 0), key=lambda r: (r[1], r[0], r[2]))
    ends = [r[1] for r in spans]
    best: list[tuple[float, int]] = [(0.0, -1)]
    for k, r in enumerate(spans):
        take = best[bisect_right(ends, r[0], 0, k)][0] + r[3]
        best.append((take, k) if take > best[k][0] else (best[k][0], -1))
    out, k = [], len(spans)
    while k:
        if best[k][1] < 0:
            k -= 1
        else:
            r = spans[best[k][1]]
            out.append((r[2], r[0], r[1]))
            k = bisect_right(ends, r[0], 0, best[k][1])
    return out[::-1]


def added_spans(text: str, base: list[tuple[int, int, int]], found: list[tuple]) -> list[tuple[int, int, int]]:
    """What the tagger adds to the rules' spans, as they are."""
    taken = sorted((a, b) for _, a, b in base)
    starts, reach = [a for a, _ in taken], list(np.maximum.accumulate([b for _, b in taken])) if taken else []
    out = []
    for tag, start, end in reconciled(found):
        start, end = trimmed(text, start, end)
        before = bisect_right(starts, end - 1)
        if start < end and not (before and reach[before - 1] > start) and passes(tag - 1, text[start:end]):
            out.append((tag - 1, start, end))
    return out


def tagged(tagger: Tagger, texts: list[str]) -> list[list[tuple]]:
    """For each text what its windows hold: start, end, tag, score, cut at the left, cut at the right."""
    sizes = np.array([len(t) for t in texts], np.int64)
    out: list[list[tuple]] = [[] for _ in texts]
    doc, start, length = window_bounds(sizes)
    if not len(doc):
        return out
    begin = (np.cumsum(sizes) - sizes)[doc]
    for w, a, b, tag, score in decode_windows(tagger, symbols("".join(texts)), begin + start, length):
        at = int(start[w])
        out[doc[w]].append((at + a, at + b, tag, score, a == 0 and at > 0, b == length[w] and at + b < sizes[doc[w]]))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame, tagger: Tagger, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, the numbers of the rules' spans by kind, their digest, all spans and how many were added.

    ``spans`` is "kind:start:end" in code points, end exclusive, by kind and start. ``base_sha256`` is the
    digest of the rules' spans alone, written alike.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def annotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text"), BLOCK_BYTES):
                ids = batch.column("doc_id").slice(block.rows.start, len(block))
                texts = [block.data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(block.offsets[:-1], block.offsets[1:], strict=True)]
                base = [base_spans(t) for t in texts]
                more = [added_spans(*x) for x in zip(texts, base, tagged(tagger, texts), strict=True)]
                counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in range(len(KINDS))]
                digests = pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b in base], pa.string())
                spans = pa.array([_joined(sorted(b + m)) for b, m in zip(base, more, strict=True)], pa.string())
                columns = [ids, *counts, digests, spans, pa.array([len(m) for m in more], pa.int64())]
                names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(annotate, f"doc_id {id_type}, {counts}, base_sha256 string, spans string, n_added long")

"""JSON of recording services into transcripts; shapes differ, so utterances are found by their keys."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

__all__ = ["json_transcripts", "meetings_of", "utterances_of"]

# Keys under which services keep what was said and by whom, and meetings of a list.
SAID = ("text", "texto", "transcript", "sentence", "content", "raw_text")
BY = ("speaker", "speaker_name", "speakerName", "falante", "participant", "name", "speaker_id")
MEETING = ("transcricao", "transcript", "transcription", "texto")
DEPTH = 6


def _value(row: dict, keys: tuple[str, ...]) -> str | None:
    for k in keys:
        v = row.get(k)
        if isinstance(v, dict):
            v = v.get("name") or v.get("id")
        if isinstance(v, str | int) and str(v).strip():
            return str(v).strip()
    return None


def _said(row: dict) -> str | None:
    text = _value(row, SAID)
    words = row.get("words")
    if text is None and isinstance(words, list):
        text = " ".join(w for x in words if isinstance(x, dict) and (w := _value(x, ("punctuated_word", "word", "text")))) or None
    return text


def utterances_of(node: object, depth: int = 0) -> list[tuple[str | None, str]]:
    """(speaker, text) of the longest list of utterances in a document, down to six levels."""
    if depth > DEPTH:
        return []
    if isinstance(node, list):
        own = [(_value(x, BY), t) for x in node if isinstance(x, dict) and (t := _said(x))]
        return max([own, *(utterances_of(x, depth + 1) for x in node)], key=len)
    if isinstance(node, dict):
        return max([[], *(utterances_of(x, depth + 1) for x in node.values())], key=len)
    return []


def meetings_of(node: object) -> list[dict] | None:
    """The records of a list of meetings (each with its whole transcript and a title or date), else null."""
    rows = node if isinstance(node, list) else []
    whole = [x for x in rows if isinstance(x, dict) and _value(x, MEETING) and any(k in x for k in ("titulo", "title", "data", "date", "cliente", "customer"))]
    return whole if rows and len(whole) == len(rows) else None


def _items(path: str, text: str | None) -> Iterator[tuple[str, int, str | None, str | None, str | None, str | None]]:
    try:
        node = json.loads(text or "")
    except ValueError:
        yield path, 0, None, None, None, None
        return
    many = meetings_of(node)
    if many is not None:
        for i, x in enumerate(many):
            yield path, i, _value(x, MEETING), _value(x, ("titulo", "title")), _value(x, ("cliente", "customer")), _value(x, ("data", "date"))
        return
    lines = [f"{who}: {said}" if who else said for who, said in utterances_of(node)]
    yield path, 0, "\n".join(lines) or None, None, None, None


def json_transcripts(files: DataFrame) -> DataFrame:
    """path, item, text, title, customer, date of JSON files (path, text): one row a meeting. Broken JSON and
    documents without utterances give one row with a null text."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [r for p, t in zip(frame["path"], frame["text"], strict=True) for r in _items(p, t)]
            yield pd.DataFrame(rows, columns=["path", "item", "text", "title", "customer", "date"])

    return files.select("path", "text").mapInPandas(task, "path string, item long, text string, title string, customer string, date string")

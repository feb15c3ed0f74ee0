"""Files of many formats into transcripts: one row per item, text, audio or ignored with its reason.

Bytes are read by Spark (``binaryFile``), so any store that Spark reads will do. Containers are opened in
Arrow tasks with the standard library; everything after that is DataFrame expressions.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

__all__ = ["decode", "docx_text", "items_of_files", "odt_text", "read_files", "rtf_text", "sheet_rows", "unpack"]

# The limits of an item's text, nesting of archives, and what systems leave in them.
LEAST_CHARS, MOST_CHARS = 20, 1_500_000
DEPTH = 3
JUNK = re.compile(r"(^|/)(__MACOSX/|\.DS_Store$|Thumbs\.db$|desktop\.ini$|\._)")
TEXT = ("txt", "md", "vtt", "srt", "sbv", "csv", "tsv", "json", "log")
AUDIO = ("mp3", "wav", "m4a", "ogg", "flac", "aac", "mp4", "webm")
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
OPEN = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
# RTF destinations whose groups hold no text, and control words that stand for characters.
RTF_HIDDEN = {"colortbl", "fonttbl", "footer", "header", "info", "listtable", "pict", "stylesheet"}
RTF_CHARACTERS = {"par": "\n", "line": "\n", "tab": "\t", "bullet": "\u2022", "emdash": "\u2014", "endash": "\u2013", "lquote": "\u2018", "rquote": "\u2019"}
RTF_TOKEN = re.compile(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-f]{2})|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)", re.IGNORECASE)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of every file under ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def decode(raw: bytes) -> str:
    """UTF-16 and UTF-8 by their marks, UTF-8 where it is valid, else Windows-1252."""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return raw.decode("utf-16", errors="replace")
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return raw.decode("cp1252", errors="replace")


def docx_text(raw: bytes) -> str:
    """Paragraphs of a word-processing document, a line each."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{WORD}t")) for p in root.iter(f"{WORD}p"))


def odt_text(raw: bytes) -> str:
    """Paragraphs and headings of an open document, a line each, with its tabs, breaks and repeated spaces."""

    def text_of(node: ElementTree.Element) -> str:
        inner = {f"{OPEN}tab": "\t", f"{OPEN}line-break": "\n"}.get(node.tag, node.text or "")
        if node.tag == f"{OPEN}s":
            inner = " " * int(node.get(f"{OPEN}c", "1"))
        return inner + "".join(text_of(c) + (c.tail or "") for c in node)

    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("content.xml"))
    return "\n".join(text_of(p) for p in root.iter() if p.tag in (f"{OPEN}p", f"{OPEN}h"))


def rtf_text(raw: bytes) -> str:
    """The text of an RTF document. Groups of fonts, styles, pictures and the like, and those marked as
    optional, hold none; bytes are Windows-1252, and the replacement after a Unicode character is skipped."""
    if not raw.startswith(b"{\\rtf"):
        raise ValueError("not RTF")
    out: list[str] = []
    hidden, skip, stack = False, 0, []
    for word, number, code, symbol, brace, plain in RTF_TOKEN.findall(raw.decode("cp1252", errors="replace")):
        if brace == "{":
            stack.append(hidden)
        elif brace == "}":
            hidden, skip = stack.pop() if stack else False, 0
        elif symbol == "*" or word in RTF_HIDDEN:
            hidden = True
        elif hidden:
            continue
        elif word == "u" and number:
            out.append(chr(int(number) % 65_536))
            skip = 1
        elif word:
            out.append(RTF_CHARACTERS.get(word, ""))
        else:
            text = bytes([int(code, 16)]).decode("cp1252", errors="replace") if code else {"~": "\u00a0", "_": "-"}.get(symbol, symbol if symbol in "\\{}" else "") or plain
            out.append(text[skip:])
            skip = max(0, skip - len(text))
    # Characters beyond the first plane come as two halves.
    return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", errors="replace")


def sheet_rows(raw: bytes) -> list[list[str]]:
    """Cells of a workbook's first sheet, with shared and inline strings."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{SHEET}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{SHEET}si")]
        first = min(n for n in names if re.match(r"xl/worksheets/sheet\d+\.xml$", n))
        root = ElementTree.fromstring(z.read(first))
    out = []
    for row in root.iter(f"{SHEET}row"):
        cells: list[str] = []
        for c in row.iter(f"{SHEET}c"):
            letters = re.match(r"[A-Z]*", c.get("r", ""))[0]
            place = 0
            for x in letters:
                place = place * 26 + ord(x) - 64
            cells += [""] * (place - 1 - len(cells))
            value = c.find(f"{SHEET}v")
            text = "".join(t.text or "" for t in c.iter(f"{SHEET}t")) if c.get("t") == "inlineStr" else (value.text or "" if value is not None else "")
            cells.append(shared[int(text)] if c.get("t") == "s" and text else text)
        out.append(cells)
    return out


def _name(info: zipfile.ZipInfo) -> str:
    """Names without the UTF-8 mark are code page 437 to the library; archives mean 850."""
    if info.flag_bits & 0x800:
        return info.filename
    try:
        return info.filename.encode("cp437").decode("cp850")
    except (UnicodeEncodeError, UnicodeDecodeError):
        return info.filename


def unpack(path: str, raw: bytes, depth: int = 0) -> Iterator[tuple[str, bytes | None, str | None]]:
    """(path, content, reason) of a file, or of everything in an archive, up to ``DEPTH`` levels."""
    if not path.lower().endswith(".zip"):
        yield path, raw, None
        return
    if depth >= DEPTH:
        yield path, None, "nested too deep"
        return
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            for info in z.infolist():
                name = _name(info)
                if info.is_dir() or JUNK.search(name):
                    continue
                if info.flag_bits & 1:
                    yield f"{path}/{name}", None, "encrypted"
                else:
                    yield from unpack(f"{path}/{name}", z.read(info), depth + 1)
    except zipfile.BadZipFile:
        yield path, None, "broken archive"


def _item(path: str, raw: bytes | None, reason: str | None) -> tuple[str, str, str | None, str | None]:
    kind = path.rpartition(".")[2].lower()
    if reason:
        return path, "ignored", None, reason
    if kind in AUDIO:
        return path, "audio", None, None
    try:
        if kind == "docx":
            text = docx_text(raw)
        elif kind in ("odt", "rtf"):
            text = odt_text(raw) if kind == "odt" else rtf_text(raw)
        elif kind == "xlsx":
            text = "\n".join("\t".join(r) for r in sheet_rows(raw))
        elif kind in TEXT:
            text = decode(raw)
        else:
            return path, "ignored", None, "format not supported"
    except (KeyError, ValueError, zipfile.BadZipFile, ElementTree.ParseError):
        return path, "ignored", None, "unreadable"
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if len(text.strip()) < LEAST_CHARS:
        return path, "ignored", None, "too short"
    if len(text) > MOST_CHARS:
        return path, "ignored", None, "too long"
    return path, "text", text, None


def items_of_files(files: DataFrame) -> DataFrame:
    """path, kind (text, audio, ignored), text, reason: every file ends as exactly one kind; archives as
    their files. A null content is an empty file."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [_item(*x) for path, raw in zip(frame["path"], frame["content"], strict=True) for x in unpack(path, bytes(raw or b""))]
            yield pd.DataFrame(rows, columns=["path", "kind", "text", "reason"])

    return files.select("path", "content").mapInPandas(task, "path string, kind string, text string, reason string")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))

"""Files, archives and captions of our own making."""

from __future__ import annotations

import io
import zipfile

from colloquy.sources import captions as C
from colloquy.sources import files as S

LINE = "uma linha de texto com mais de vinte caracteres"


def packed(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries:
            z.writestr(name, data)
    return out.getvalue()


DOCX = packed([("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Ana: bom dia a todos</w:t></w:r></w:p><w:p><w:r><w:t>Bia: oi</w:t></w:r></w:p></w:body></w:document>')])
XLSX = packed(
    [
        ("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>cliente</t></si><si><t>transcricao da conversa</t></si></sst>'),
        ("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2" t="inlineStr"><is><t>Loja</t></is></c><c r="B2"><v>7</v></c></row></sheetData></worksheet>'),
    ]
)


def test_every_file_ends_as_one_kind(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(("coração " + LINE).encode("cp1252"))
    (tmp_path / "b.txt").write_bytes(LINE.encode("utf-16"))
    (tmp_path / "c.mp3").write_bytes(b"x")
    (tmp_path / "d.exe").write_bytes(b"x")
    (tmp_path / "e.txt").write_bytes(b"curto")
    (tmp_path / "f.docx").write_bytes(DOCX)
    (tmp_path / "g.xlsx").write_bytes(XLSX)
    inner = packed([("deep.txt", LINE), ("__MACOSX/x", "x"), (".DS_Store", "x")])
    (tmp_path / "h.zip").write_bytes(packed([("in.zip", inner), ("more.txt", LINE), ("bad.docx", b"no")]))
    (tmp_path / "i.zip").write_bytes(b"broken")
    rows = {r.path.rpartition(str(tmp_path.name) + "/")[2]: r for r in S.items_of_files(S.read_files(spark, str(tmp_path))).collect()}
    assert {k: v.kind for k, v in rows.items()} == {
        "a.txt": "text", "b.txt": "text", "c.mp3": "audio", "d.exe": "ignored", "e.txt": "ignored", "f.docx": "text", "g.xlsx": "text",
        "h.zip/in.zip/deep.txt": "text", "h.zip/more.txt": "text", "h.zip/bad.docx": "ignored", "i.zip": "ignored",
    }
    assert rows["a.txt"].text.startswith("coração") and rows["b.txt"].text == LINE
    assert rows["f.docx"].text == "Ana: bom dia a todos\nBia: oi"
    assert rows["g.xlsx"].text == "cliente\t\ttranscricao da conversa\nLoja\t7"
    assert all((r.kind == "ignored") == (r.reason is not None) for r in rows.values())


VTT = "WEBVTT\n\n00:00:01.000 --> 00:00:02.000\n<v Ana Paula>Bom dia</v>\n\n00:00:02.500 --> 00:00:04.000\n<v Ana Paula>a todos</v>\n\n00:05.000 --> 00:06.000\nBia: oi, tudo bem?\n"
SRT = "1\n00:00:01,000 --> 00:00:02,000\nisto vai\n\n2\n00:00:02,100 --> 00:00:03,000\nisto vai crescendo\n\n3\n00:00:09,000 --> 00:00:10,000\noutro assunto\n"


def test_captions(spark):
    cues = C.caption_cues(spark.createDataFrame([("v", VTT), ("s", SRT), ("n", "nada")], "path string, text string"))
    got = {r.path: r.text for r in C.captions_to_text(cues).collect()}
    assert got == {"v": "Ana Paula: Bom dia a todos\nBia: oi, tudo bem?", "s": "isto vai crescendo\noutro assunto"}


def test_speaker_names_and_merging(spark):
    rows = [(1, 0, "Speaker 2", "a"), (1, 1, "speaker 2", "b"), (1, 2, "ana.lima@x.com", "c"), (1, 3, "Speaker 1", "d"), (1, 4, "Maria da Silva Souza", "e"), (2, 0, "Ana", "f")]
    turns = C.normalised_speakers(spark.createDataFrame(rows, "doc_id long, turn int, speaker string, text string"))
    got = [(r.doc_id, r.speaker, r.text) for r in C.merged_turns(turns).orderBy("doc_id", "turn").collect()]
    assert got == [(1, "Falante A", "a b"), (1, "Ana Lima", "c"), (1, "Falante B", "d"), (1, "Maria Souza", "e"), (2, "Ana", "f")]

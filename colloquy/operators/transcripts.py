"""Transcripts into speaker labels, turns and sentences, all with code point offsets into the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import CUT, INAUDIBLE, TIMESTAMP, _pieces, blank, count_words, fold, once, parts, redact

__all__ = ["attributable", "clean_text", "prepared", "sentences", "spans", "speaker_labels", "turns"]

# The form of a label, words that are no speaker, and lower-case parts of names.
LABEL = (
    r"^[ \t>-]*(?:\[([^\]\n]{2,45})\]|(\p{Lu}[\p{L}.'’ ]{1,40}?)(?:(?:\s*[—–]\s*|\s+-\s+)([^:\n]{1,40}))?(?:\s*\(([^)\n]{1,30})\))?)\s*:(?:[ \t]|$)"
)
NOT_SPEAKERS = (
    "obs", "nota", "ps", "atenção", "atencao", "resumo", "obrigado", "olha", "veja", "exemplo", "importante", "link", "http", "https", "obs.", "pauta", "agenda",
)
PARTICLES = ("de", "da", "do", "dos", "das", "e", "del", "di")
ABBREVIATIONS = (
    "sr", "sra", "srta", "dr", "dra", "prof", "profa", "eng", "adv", "exmo", "av", "r", "no", "n", "pag", "pág", "art", "ltda", "cia", "etc", "ex", "fig", "obs", "ref", "cap", "vs", "aprox",
)
#: More speakers than this are noise of automatic recognition.
MOST_SPEAKERS = 6


def prepared(transcripts: DataFrame) -> DataFrame:
    """Adds safe (masked, the text that is quoted) and search (folded, time stamps and marks blanked) and
    inaudible, the number of marks. Both have the text's length, so offsets hold in either."""
    rows = transcripts.withColumn("safe", redact(F.col("text")))
    search = blank(blank(fold(F.col("safe")), TIMESTAMP), fold_pattern(INAUDIBLE))
    return rows.withColumn("search", search).withColumn("inaudible", F.coalesce(F.regexp_count("safe", F.lit(INAUDIBLE)), F.lit(0)))


def fold_pattern(pattern: str) -> str:
    return pattern.replace("[ií]", "i").replace("[êe]", "e")


def clean_text(text: Column) -> Column:
    """A text to read: no time stamps, single blanks, no more than one empty line. Not for offsets."""
    bare = F.regexp_replace(F.regexp_replace(text, TIMESTAMP, ""), r"[ \t]+", " ")
    return F.trim(F.regexp_replace(bare, r"\n{3,}", "\n\n"))


def _is_name(raw: Column) -> Column:
    """Up to three words, capitalised or all capitals; particles may be lower case."""
    words = F.filter(F.split(raw, r"\s+"), lambda w: F.length(w) > 0)

    def fits(w: Column, i: Column) -> Column:
        first = F.substring(w, 1, 1)
        return ((i > 0) & F.lower(w).isin(*PARTICLES)) | ((first == F.upper(first)) & (first != F.lower(first)))

    marked = F.transform(words, fits)
    return F.size(words).between(1, 3) & ((raw == F.upper(raw)) | F.forall(marked, lambda ok: ok))


#: The form of a label at the start of any line of a text.
_LINE_LABEL = "(?dm)" + LABEL.replace(r"\s", r"[ \t\x0B\f\r]")


def _named(label: Column) -> Column:
    """Struct (speaker, title) of a label."""
    group = lambda k: F.trim(F.regexp_extract(label, _LINE_LABEL, k))
    either = lambda a, b: F.when(F.length(group(a)) > 0, group(a)).when(F.length(group(b)) > 0, group(b))
    return F.struct(either(1, 2).alias("speaker"), either(3, 4).alias("title"))


def _is_label(text: Column) -> Column:
    """Whether a text begins with a speaker's label."""

    def speaks(speaker: Column) -> Column:
        key = F.regexp_replace(F.lower(speaker), "[.:]", "")
        return speaker.isNotNull() & ~key.isin(*NOT_SPEAKERS) & _is_name(speaker)

    return F.when(text.rlike(r"\A" + _LINE_LABEL.replace("(?dm)^", "(?dm)")), once(_named(text).speaker, speaks)).otherwise(F.lit(False))


def _segments(text: Column) -> Column:
    """A text cut before each speaker's label: array of (at, text); the first stands before any label."""
    strings = F.flatten(F.transform(_pieces(text, _LINE_LABEL), lambda p: F.array(p.before, F.coalesce(p.hit, F.lit("")))))
    return parts(strings, _is_label)


def speaker_labels(transcripts: DataFrame, text_col: str = "safe") -> DataFrame:
    """doc_id, label_start, text_start, speaker, title of every line that begins with a speaker's label."""
    rows = transcripts.select("doc_id", F.explode(F.slice(_segments(F.col(text_col)), 2, 1 << 30)).alias("s"))
    label = F.regexp_extract("s.text", _LINE_LABEL, 0)
    return rows.select("doc_id", F.col("s.at").alias("label_start"), (F.col("s.at") + F.length(label)).alias("text_start"), _named(F.col("s.text")).alias("n")).select("doc_id", "label_start", "text_start", "n.speaker", "n.title")


def spans(transcripts: DataFrame, text_col: str = "safe") -> DataFrame:
    """doc_id, turn, speaker, title, start, end, text, words, diarised: the turns of diarised transcripts (two
    labels or more, of two speakers or more), and every other text as one span of nobody.

    A text is read once and cut where it stands: what leaves is each turn with its own words. What stands
    before the first label of a diarised transcript belongs to no turn. Null texts have no span.
    """

    def told(segments: Column) -> Column:
        turns = F.transform(F.slice(segments, 2, 1 << 30), lambda s: F.struct(s.at.alias("at"), s.text.alias("said"), _named(s.text).alias("n")))

        def cut(found: Column) -> Column:
            names = F.array_distinct(F.transform(found, lambda t: F.lower(t.n.speaker)))
            whole = F.array_join(F.transform(segments, lambda s: s.text), "")
            nobody = F.struct(F.lit(None).cast("string").alias("speaker"), F.lit(None).cast("string").alias("title"))
            alone = F.array(F.struct(F.lit(0).alias("at"), whole.alias("said"), nobody.alias("n")))
            return F.when((F.size(found) >= 2) & (F.size(names) >= 2), found).otherwise(alone)

        return once(turns, cut)

    rows = transcripts.where(F.col(text_col).isNotNull()).select("doc_id", F.posexplode(once(_segments(F.col(text_col)), told)).alias("turn", "t")).select("doc_id", "turn", "t.*")
    diarised = F.col("n.speaker").isNotNull()
    label = F.when(diarised, F.length(F.regexp_extract("said", _LINE_LABEL, 0))).otherwise(0)
    rows = rows.select("doc_id", "turn", "n.speaker", "n.title", diarised.alias("diarised"), (F.col("at") + F.length("said")).alias("end"), (F.col("at") + label).alias("from"), F.substring("said", label + 1, F.length("said")).alias("said"))
    trimmed = F.regexp_replace("said", r"^\s+|\s+$", "")
    start = F.col("from") + F.length("said") - F.length(F.regexp_replace("said", r"^\s+", ""))
    return rows.select("doc_id", "turn", "speaker", "title", start.alias("start"), "end", trimmed.alias("text"), count_words(F.col("said")).alias("words"), "diarised")


def turns(transcripts: DataFrame, text_col: str = "safe") -> DataFrame:
    """doc_id, turn, speaker, title, start, end, text, words of diarised transcripts. Others have no turns."""
    return spans(transcripts, text_col).where("diarised").drop("diarised")


def attributable(roles: DataFrame) -> DataFrame:
    """doc_id, speakers, fragmented, attributable: whether what the client says can be told apart."""
    rows = roles.groupBy("doc_id").agg(F.count("*").alias("speakers"), F.bool_or(F.col("side") == "client").alias("client"))
    fragmented = F.col("speakers") > MOST_SPEAKERS
    return rows.select("doc_id", "speakers", fragmented.alias("fragmented"), (~fragmented & F.col("client")).alias("attributable"))


def sentences(spans: DataFrame, text_col: str = "text", start_col: str = "start") -> DataFrame:
    """Rows of ``spans`` once for each sentence, with sentence, sentence_start and sentence_end.

    A sentence ends after ``.``, ``!`` or ``?`` (and closing marks) where the text ends, or a blank and then a
    capital, digit, quote or dash follow; not after an abbreviation or initial, nor inside a number.
    """
    short = "|".join(ABBREVIATIONS)
    no_dot = rf"(?<![\p{{L}}])(?i:{short}|\p{{L}})\.$"
    # Every candidate end closes a piece; a piece that ends with an abbreviation is open to the next one.
    piece = r"(?s).+?(?:(?:[!?]|(?<![0-9])\.|\.(?![0-9]))[.!?\"'”’)\]]*(?=\s+[\p{Lu}0-9\"'“—-]|\s*$)|$)"

    def cut(pieces: Column) -> Column:
        fresh = F.transform(pieces, lambda p, i: F.when((i == 0) | ~F.get(pieces, i - 1).rlike(no_dot), F.concat(F.lit(CUT), F.translate(p, CUT, " "))).otherwise(F.translate(p, CUT, " ")))
        return parts(F.split(F.array_join(fresh, ""), CUT, -1), lambda x: F.lit(True))

    found = once(F.regexp_extract_all(F.col(text_col), F.lit(piece), F.lit(0)), cut)
    rows = spans.select("*", F.explode(F.filter(found, lambda x: F.length(x.text) > 0)).alias("s"))
    bare = F.regexp_replace("s.text", r"^\s+|\s+$", "")
    lead = F.length("s.text") - F.length(F.regexp_replace("s.text", r"^\s+", ""))
    begin = (F.col(start_col) if start_col in spans.columns else F.lit(0)) + F.col("s.at") + lead
    return rows.withColumn("sentence", bare).withColumn("sentence_start", begin).withColumn("sentence_end", begin + F.length(bare)).where(F.length("sentence") > 0).drop("s")

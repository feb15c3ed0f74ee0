"""Fill-in-middle training texts: prefix, middle and suffix rearranged behind sentinels, and restored.

Everything is Spark SQL: a regular expression makes the units, a digest of the document's id places the two
cuts, slices make the parts, and the sentinels alone give the text back.

Defined results: a null text is empty; an empty text, and one that holds a sentinel, stays as it is (form
``plain``); rows that repeat are each transformed alike; a null id is hashed as an empty string; an empty
table gives an empty one; other columns of the input are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

__all__ = ["LINES", "SENTINELS", "fill_in_middle", "restored_text"]

#: Units of a text, matched left to right: lines with their end.
LINES = r"[^\n]*\n|[^\n]+"

#: What stands before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")


def _check(sentinels: Sequence[str]) -> None:
    """An error unless the sentinels can always be told from a text that holds none of them.

    If no end of one is the beginning of another (itself included), no sentinel can arise where a part of
    the text meets a sentinel, so each is found exactly where it was written.
    """
    if len(set(sentinels)) != 3 or not all(sentinels):
        raise ValueError("three different sentinels are needed")
    for a in sentinels:
        for b in sentinels:
            if any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)) + (a != b))) or (a != b and b in a):
                raise ValueError(f"{a!r} and {b!r} overlap")


def _quoted(text: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in text)


def _part(digest: Column, k: int) -> Column:
    """The k-th group of eight hex digits as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 7,
    percent: int = 100,
    spm_percent: int = 50,
    units: str = LINES,
    sentinels: Sequence[str] = SENTINELS,
) -> DataFrame:
    """One row a document: doc_id, n (units), form, prefix_chars, middle_chars, output.

    ``percent`` of the texts are rearranged, of those ``spm_percent`` as suffix-prefix-middle (``spm``) and
    the others as prefix-suffix-middle (``psm``). Which, and where they are cut, follows from ``seed`` and id.
    """
    _check(sentinels)
    first, second, third = sentinels
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), digest.alias("digest"))
    rows = rows.withColumn("units", F.regexp_extract_all("text", F.lit(units), F.lit(0)))
    n = F.size("units").cast("long")
    one, other = _part(F.col("digest"), 0) % (n + 1), _part(F.col("digest"), 1) % (n + 1)
    whole = (F.length("text") == 0) | (_part(F.col("digest"), 2) % 100 >= percent)
    for s in sentinels:
        whole = whole | F.contains("text", F.lit(s))
    form = F.when(whole, "plain").when(_part(F.col("digest"), 3) % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "units", n.alias("n"), F.least(one, other).cast("int").alias("a"), F.greatest(one, other).cast("int").alias("b"), form.alias("form"))
    slices = {
        "prefix": F.slice("units", F.lit(1), F.col("a")),
        "middle": F.slice("units", F.col("a") + 1, F.col("b") - F.col("a")),
        "suffix": F.slice("units", F.col("b") + 1, F.size("units") - F.col("b")),
    }
    rows = rows.select("doc_id", "text", "n", "form", *(F.array_join(v, "").alias(k) for k, v in slices.items()))
    psm = F.concat(F.lit(first), "prefix", F.lit(second), "suffix", F.lit(third), "middle")
    spm = F.concat(F.lit(second), "suffix", F.lit(first), "prefix", F.lit(third), "middle")
    cut = F.col("form") != "plain"
    return rows.select(
        "doc_id",
        "n",
        "form",
        F.when(cut, F.length("prefix").cast("long")).alias("prefix_chars"),
        F.when(cut, F.length("middle").cast("long")).alias("middle_chars"),
        F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text")).alias("output"),
    )


def restored_text(output: str | Column, form: str | Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text that an output of :func:`fill_in_middle` was made of, from the sentinels and the form alone."""
    _check(sentinels)
    output = F.col(output) if isinstance(output, str) else output
    form = F.col(form) if isinstance(form, str) else form
    parts = F.split(output, "|".join(_quoted(s) for s in sentinels))
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)

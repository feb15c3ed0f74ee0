"""Quality rules: fixed limits, then robust multivariate outliers by language and source.

Each text gives a vector of transformed statistics. A minimum-covariance-determinant estimate of a
group's centre and covariance has several ``STARTS``: medians and median deviations over all
statistics, and over part of them. Each repeats concentration steps (fit on the ``SHARE`` of rows that
are nearest, measure all rows anew) until no determinant shrinks by ``STABLE`` of itself, at most
``STEPS`` times; a group takes the fit of least determinant. A text is an outlier when
its squared Mahalanobis distance, scaled so that the group's median is that of a chi-squared
variable, is above ``CUTOFF``. All of it is DataFrame expressions; a group's order statistics come
from counts of fine bins, so no group is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.storage import checkpointed

__all__ = ["FEATURES", "least_determinant", "quality_rules", "text_statistics"]

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
FEATURES = ("x0", "x1", "x2", "x3", "x4")
#: Share of a group that a concentration step fits, and the most steps.
SHARE = 0.75
STEPS = 12
#: Statistics whose distance from the medians, in median deviations, picks a start's first rows.
STARTS = ((0, 1, 2, 3, 4), (0, 1), (2, 3, 4))
STABLE = 1e-3
#: Rows that a group needs for its own estimate; smaller groups pool by language, then altogether.
LEAST_ROWS = 100
#: Each statistic's spread that counts as noise: most texts have no symbol and no repeated line, and
#: without it the few that have one would be infinitely far away.
NOISE = (1.0, 0.05, 0.02, 0.2, 0.15)
#: Quantiles of a chi-squared variable with five degrees of freedom: the median and 1 - 1.4e-9.
MEDIAN_5 = 4.351
CUTOFF = 50.0
BINS = 64


def text_statistics(text: Column) -> dict[str, Column]:
    """Aggregable facts of one text as expressions over its ``words`` column; see :func:`quality_rules`."""
    text = F.coalesce(text, F.lit(""))
    bare = F.translate(text, SPACES, "")
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.length(F.translate(line, SPACES, "")) > 0)
    return {
        "words": F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
        "lines": lines,
        "word_chars": F.length(bare).cast("long"),
        "n_symbols": (F.length(bare) - F.length(F.translate(bare, SYMBOLS, ""))).cast("long"),
    }


def _repeat_words(stats: DataFrame) -> DataFrame:
    """Adds n_repeat_words: the words inside 3-word windows that stand twice or more in the text."""
    words = F.col("words")
    at = lambda i: F.element_at(words, i)
    windows = F.transform(F.sequence(F.lit(1), F.size("words") - 2), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))
    stats = stats.withColumn("windows", F.when(F.size("words") > 2, windows))
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    stats = stats.withColumn("placed", F.when(again, placed)).drop("windows")
    equal = lambda i: F.element_at(F.col("placed"), i).h == F.element_at(F.col("placed"), i + 1).h
    # twin[i]: whether the i-th window in hash order equals the next one (1-based).
    twin = F.transform(F.sequence(F.lit(1), F.size("placed") - 1), equal)
    stats = stats.withColumn("twin", F.when(F.col("placed").isNotNull(), twin))
    found = F.filter(
        "placed",
        lambda x, i: F.coalesce(F.get(F.col("twin"), i), F.lit(False)) | F.coalesce(F.get(F.col("twin"), i - 1), F.lit(False)),
    )
    covered = F.array_distinct(F.flatten(F.transform(found, lambda x: F.array(x.i, x.i + 1, x.i + 2))))
    return stats.withColumn("n_repeat_words", F.when(F.col("placed").isNotNull(), F.size(covered)).otherwise(0).cast("long")).drop("placed", "twin")


def _base(documents: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    docs = documents.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(lang_col).cast("string").alias("lang"),
        F.col(source_col).cast("string").alias("source"),
        *(v.alias(k) for k, v in text_statistics(F.col(text_col).cast("string")).items()),
    )
    stats = _repeat_words(docs).select(
        "doc_id",
        "lang",
        "source",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("lines").alias("n_lines"),
    )
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return stats.withColumn("base_failed", failed)


def _vectors(base: DataFrame) -> DataFrame:
    """Logarithms of length and mean word length, and shares of symbols, repeated lines and words."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    features = (
        F.log(n.cast("double")),
        F.log1p(F.col("word_chars") / n),
        F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        F.col("n_repeat_words") / n,
    )
    return base.select("*", *(f.alias(x) for f, x in zip(features, FEATURES, strict=True)))


def _grouped(base: DataFrame, least: int) -> DataFrame:
    """Adds ``grp``: language and source, or what a small group is pooled to; null where all is too small."""
    usable = base.where("not base_failed")
    by_source = usable.groupBy("lang", "source").agg(F.count("*").alias("n"))
    by_lang = Window.partitionBy("lang")
    alone = F.col("n") >= least
    pooled = F.sum(F.when(alone, 0).otherwise(F.col("n")))
    counts = by_source.withColumn("in_lang", pooled.over(by_lang)).withColumn("level", F.when(alone, 2).when(F.col("in_lang") >= least, 1).otherwise(0))
    rest = counts.where("level = 0").agg(F.sum("n")).first()[0] or 0
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    group = F.when(F.col("level") == 2, F.concat_ws("\x00", named("lang"), named("source"))).when(F.col("level") == 1, named("lang"))
    group = group.otherwise(F.lit("all") if rest >= least else F.lit(None).cast("string"))
    groups = counts.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), group.alias("grp"))
    match = F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))
    return base.join(groups, match, "left").drop("g_lang", "g_source")


def _quantile(rows: DataFrame, keys: list[str], bin_col: str, share: float) -> DataFrame:
    """The bin in which each group's ``share`` quantile lies, as ``cut``."""
    counts = rows.groupBy(*keys, bin_col).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*keys).orderBy(bin_col).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    return counts.where(F.col("upto") >= F.ceil(F.col("all") * share)).groupBy(*keys).agg(F.min(bin_col).alias("cut"))


def _distance_bin(d: Column) -> Column:
    """Bins of a squared distance, about 1 % wide."""
    return F.floor(F.log2(d + 1e-9) * BINS).cast("long")


def _start(rows: DataFrame) -> DataFrame:
    """Each group's medians and median deviations (columns m0.., s0..)."""
    scaled = F.posexplode(F.array(*(F.round(F.col(x) * 1024).cast("long") for x in FEATURES))).alias("dim", "value")
    long = rows.select("grp", scaled)
    middle = _quantile(long, ["grp", "dim"], "value", 0.5).withColumnRenamed("cut", "mid")
    off = long.join(middle, ["grp", "dim"]).select("grp", "dim", F.abs(F.col("value") - F.col("mid")).alias("off"))
    spread = _quantile(off, ["grp", "dim"], "off", 0.5).withColumnRenamed("cut", "mad")
    both = middle.join(spread, ["grp", "dim"])
    pick = lambda c, k: F.max(F.when(F.col("dim") == k, F.col(c))) / 1024.0
    medians = (pick("mid", k).alias(f"m{k}") for k in range(len(FEATURES)))
    spreads = (F.greatest(pick("mad", k) * 1.4826, F.lit(NOISE[k])).alias(f"s{k}") for k in range(len(FEATURES)))
    return both.groupBy("grp").agg(*medians, *spreads)


def _fit(nearest: DataFrame, keys: list[str]) -> DataFrame:
    """Mean (m0..), Cholesky factor (l00, l10, ..) and log determinant of the covariance by ``keys``."""
    p = len(FEATURES)
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    sums = nearest.groupBy(*keys).agg(
        *(F.avg(x).alias(f"m{i}") for i, x in enumerate(FEATURES)),
        *(F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"c{i}{j}") for i, j in pairs),
    )
    for i, j in pairs:
        inner = F.col(f"c{i}{j}") + (NOISE[i] ** 2 if i == j else 0.0)
        for k in range(j):
            inner = inner - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        sums = sums.withColumn(f"l{i}{j}", F.sqrt(F.greatest(inner, F.lit(NOISE[i] ** 2 / 4))) if i == j else inner / F.col(f"l{j}{j}"))
    determinant = sum((F.log(f"l{i}{i}") for i in range(1, p)), F.log("l00")) * 2
    return sums.select(*keys, determinant.alias("logdet"), *(f"m{i}" for i in range(p)), *(f"l{i}{j}" for i, j in pairs))


def _measured(rows: DataFrame, fit: DataFrame, keys: list[str]) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution."""
    joined = rows.join(fit, keys)
    p = len(FEATURES)
    for i in range(p):
        z = F.col(FEATURES[i]) - F.col(f"m{i}")
        for k in range(i):
            z = z - F.col(f"l{i}{k}") * F.col(f"z{k}")
        joined = joined.withColumn(f"z{i}", z / F.col(f"l{i}{i}"))
    d2 = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, p)), F.col("z0") * F.col("z0"))
    return joined.withColumn("d2", d2).select(*rows.columns, "d2")


def least_determinant(rows: DataFrame, share: float, steps: int) -> DataFrame:
    """The fit of each ``grp`` of ``rows`` (grp and FEATURES): grp, logdet, m0.., l00...

    Bins about 1 % wide stand for the order of distances, so a step fits ``share`` of the rows and those
    that tie with the last of them.
    """
    keys = ["grp", "start"]
    off = [F.pow((F.col(x) - F.col(f"m{i}")) / F.col(f"s{i}"), 2) for i, x in enumerate(FEATURES)]
    starts = F.array(*(F.struct(F.lit(n).alias("start"), sum((off[i] for i in part), F.lit(0.0)).alias("d2")) for n, part in enumerate(STARTS)))
    measured = checkpointed(rows.join(_start(rows), "grp").select(*rows.columns, F.inline(starts)))
    spread = rows.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(len(STARTS) - 1))))
    best = before = None
    for _ in range(steps):
        binned = measured.withColumn("bin", _distance_bin(F.col("d2")))
        nearest = binned.join(_quantile(binned, keys, "bin", share), keys).where("bin <= cut")
        fit = checkpointed(_fit(nearest, keys))
        # Of this step's fits and the best so far: bins can let a determinant grow a little.
        taken = fit if best is None else best.unionByName(fit)
        best = checkpointed(taken.groupBy("grp").agg(F.min_by(F.struct("start", *fit.columns[2:]), F.struct("logdet", "start")).alias("f")).select("grp", "f.*"))
        if before is not None:
            shrunk = before.select(*keys, F.col("logdet").alias("last")).join(fit, keys).where(F.col("logdet") < F.col("last") - STABLE)
            if shrunk.isEmpty():
                break
        before = fit
        measured = checkpointed(_measured(spread, fit, keys))
    return best.drop("start")


def quality_rules(
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    share: float = SHARE,
    steps: int = STEPS,
    least_rows: int = LEAST_ROWS,
    cutoff: float = CUTOFF,
) -> DataFrame:
    """One row for each document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, distance.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text (null: none). ``word_chars`` counts their code
    points, ``n_symbols`` characters of ``[#*$%&|<>]``, ``n_dup_lines`` lines with a word that equal an
    earlier line, ``n_repeat_words`` words in 3-word windows that stand twice or more. ``base_failed``:
    fewer than 50 words, or more than half of them repeated. Other texts are ``kept`` unless their
    scaled squared distance from the robust estimate of their language and source is above ``cutoff``.

    Null languages and sources are groups of their own. Groups under ``least_rows`` pool by language,
    then altogether; where even that is too small nothing more is rejected (distance null). Rows are
    judged one by one, so repeated rows and null ids come back as they are. Other columns are not read.
    """
    base = checkpointed(_base(documents, id_col, text_col, lang_col, source_col))
    rows = checkpointed(_grouped(_vectors(base), least_rows))
    fitted = rows.where("grp is not null and not base_failed").select("grp", *FEATURES)
    fit = least_determinant(fitted, share, steps)
    measured = _measured(fitted, fit, ["grp"])
    median = _quantile(measured.withColumn("bin", _distance_bin(F.col("d2"))), ["grp"], "bin", 0.5)
    scale = checkpointed(median.select("grp", (F.pow(F.lit(2.0), (F.col("cut") + 0.5) / BINS) / MEDIAN_5).alias("scale")))
    judged = _measured(rows.where("grp is not null and not base_failed"), fit, ["grp"]).join(scale, "grp")
    judged = judged.withColumn("distance", F.col("d2") / F.greatest(F.col("scale"), F.lit(1e-3)))
    rest = rows.where("grp is null or base_failed").withColumn("distance", F.lit(None).cast("double"))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    return judged.select(*names, "distance").unionByName(rest.select(*names, "distance")).select(*names, kept.alias("kept"), "distance")

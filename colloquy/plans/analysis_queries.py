"""From transcripts to findings, over the driver's chats as meetings between a seller and a client.

A chat becomes one labelled transcript: the assistant is Ana, the user Bruno, others Carla, with titles in
some chats; every tenth chat comes without labels, as a text of nobody. The chats are invented prose, so each
turn gets one of :data:`REMARKS`, with a number of its own; all that follows reads the text.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.functions.storage import checkpointed
from colloquy.operators import extract as X
from colloquy.operators import roles as R
from colloquy.operators import transcripts as T
from colloquy.operators.extract import Entry
from colloquy.plans.driver_tables import table
from colloquy.plans.text_queries import FOLD
from colloquy.plans.turn_queries import WORDS

__all__ = ["QUERIES", "SQL"]

#: The day of all meetings.
MEETING = dt.date(2024, 1, 10)
REMARKS = (
    "",
    " Posso te mostrar?",
    " O preço está caro.",
    " Não está caro, o sr. Silva disse.",
    " Vamos fechar em 15 dias.",
    " Hoje usamos o Acme Folha.",
    " Queremos ver o Acme na segunda.",
    " Preciso aprovar com o meu diretor.",
    " Antes tinha a Zeta.",
    " Agora avaliamos a Zeta até 31/01.",
    " Vamos cancelar o contrato.",
    " O suporte da Beta é ruim, mas o preço está caro e combinamos um desconto.",
    " Não vamos comprar nada.",
    " Vou enviar a proposta em 15 dias.",
    " Preciso que você mande o contrato até 31/01.",
    " Temos {n} mil reais para isso.",
    " Seria uns {n}, mas não comenta com ninguém.",
    " Podemos pagar até R$ {n}.500,00 por mês.",
    " São cento e vinte mil no máximo.",
    " Sou o diretor financeiro.",
    " Sou gerente de TI e falo com meu diretor.",
    " O fechamento está atrasado.",
    " A planilha trava toda semana e é um problema.",
    " Adoramos o suporte, é excelente.",
    " A integração é lenta e o suporte ficou muito ruim.",
    " Precisamos de um relatório melhor.",
    " Decidimos seguir, o próximo passo é na sexta ou na quinta.",
    " Me manda a proposta em {n} dias.",
    " Qual o prazo de implantação?",
    " Vamos abrir novas filiais e queremos o Acme.",
    " Confio em vocês.",
    " Vamos adiar a reunião para o mês que vem.",
    " O dia 31/02 não existe, fica em duas semanas.",
)
NEEDS = [Entry("closing", "vamos fechar", 5.0), Entry("cancel", "cancelar", 20.0), Entry("bad_support", "suporte[^.]{0,20}ruim", 14.0), Entry("discount", "desconto", 3.0)]
CHURN = ("cancel", "bad_support")
PRICE = "caro|preco alto"
RIVALS = [Entry("Zeta", "zeta"), Entry("Beta", "beta")]
PAST, ACTIVE = "antes|tinha", "agora|avaliamos"
DENIAL, RESOLUTION, OTHER = "nao|sem", "combinamos|resolvido", "banco"
PRODUCTS = [Entry("Acme", "acme", group="erp"), Entry("Acme Payroll", "acme folha", group="hr")]
CONTEXTS = {"possession": "usamos", "evaluating": "avaliamos", "opportunity": "queremos"}
REFUSAL = "nao vamos comprar"
OURS, THEIRS = "vou enviar", "preciso que voce"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    kind, role = F.col("conv_id") % 3, F.col("role")
    name = F.when(role == "assistant", F.when(kind == 2, "Ana (Comercial): ").otherwise("Ana: ")).when(role == "user", F.when(kind == 0, "Bruno (Diretor): ").otherwise("Bruno: ")).otherwise("Carla: ")
    name = F.when(F.col("conv_id") % 10 == 4, "").otherwise(name)
    remark = F.array(*map(F.lit, REMARKS))[((F.col("conv_id") * 7 + F.col("turn")) % len(REMARKS)).cast("int")]
    number = ((F.col("conv_id") * 13 + F.col("turn") * 5) % 90 + 10).cast("string")
    line = F.concat(name, F.coalesce("text", F.lit("")), F.replace(remark, F.lit("{n}"), number))
    lines = rows.groupBy(F.col("conv_id").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("lines"))
    return lines.select("doc_id", F.array_join("lines.line", "\n").alias("text"), F.lit(MEETING).alias("meeting_date"))


def _transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.prepared(_texts(spark, sf_dir))


def _roles(turns: DataFrame) -> DataFrame:
    return R.infer_roles(turns)


def _sentences(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sentences as extractors take them, and which transcripts tell the sides apart."""
    spans = checkpointed(T.spans(_transcripts(spark, sf_dir)))
    roles = checkpointed(_roles(spans.where("diarised")))
    who = roles.select(F.col("doc_id").alias("whose"), F.lower("speaker").alias("key"), "side")
    rows = T.sentences(spans).join(who, (F.lower("speaker") == F.col("key")) & (F.col("doc_id") == F.col("whose")), "left")
    order = Window.partitionBy("doc_id").orderBy("sentence_start")
    rows = rows.select(
        "doc_id", (F.row_number().over(order) - 1).alias("sentence_no"), F.col("sentence_start").alias("start"), T.fold(F.col("sentence")).alias("search"), F.col("sentence").alias("quote"), "side", "speaker"
    )
    return checkpointed(rows), T.attributable(roles)


def _digest(c: str) -> Column:
    return F.md5(F.col(c).cast("binary"))


def transcript_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4, T5: speaker labels and turns with offsets."""
    turns = T.turns(_transcripts(spark, sf_dir))
    return turns.select("doc_id", "turn", "speaker", "title", F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"), _digest("text").alias("text_md5"), "words")


def speaker_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides by titles, phrases, questions, length of turns, election and propagation."""
    roles = checkpointed(_roles(T.turns(_transcripts(spark, sf_dir))))
    rows = roles.join(T.attributable(roles), "doc_id")
    return rows.select("doc_id", "speaker", F.col("position").cast("long").alias("position"), "side", F.round("confidence", 4).alias("confidence"), F.round("score", 6).alias("score"), "attributable")


def transcript_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with offsets into the transcript."""
    rows, _ = _sentences(spark, sf_dir)
    return rows.select("doc_id", F.col("sentence_no").cast("long").alias("sentence_no"), F.col("start").cast("long").alias("start_at"), "side", _digest("quote").alias("quote_md5"))


def client_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the client says, once for each label and sentence."""
    found = X.statements(X.client_speech(*_sentences(spark, sf_dir)), NEEDS, least_words=3)
    return found.select("doc_id", "label", "weight", F.col("start").cast("long").alias("start_at"), _digest("quote").alias("quote_md5"))


def client_objections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objections to the price that aren't negated, and whether they were resolved."""
    client = X.client_speech(*_sentences(spark, sf_dir))
    found = X.objections(client, [Entry("price", PRICE)], DENIAL, RESOLUTION, OTHER)
    return found.select("doc_id", "label", "resolved", F.col("start").cast("long").alias("start_at"))


def meeting_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Churn signals by weight, and active competitors by their most severe mention."""
    rows, sides = _sentences(spark, sf_dir)
    churn = X.statements(X.client_speech(rows, sides), [e for e in NEEDS if e.label in CHURN])
    return X.risks(churn, X.competitors(rows, RIVALS, PAST, ACTIVE))


def product_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each product with its strongest status; a refusal of the meeting rules out opportunities."""
    rows, sides = _sentences(spark, sf_dir)
    no = X.refused(X.client_speech(rows, sides), [Entry("no", REFUSAL)])
    found = X.products(rows, PRODUCTS, CONTEXTS, no)
    return found.select("doc_id", "label", "grp", "status", "confidence", F.col("start").cast("long").alias("start_at"))


def meeting_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dates that sentences name, seen from the meeting."""
    rows, _ = _sentences(spark, sf_dir)
    due = rows.withColumn("due", X.deadline(F.col("search"), F.lit(MEETING)))
    return due.where("due is not null").select("doc_id", F.col("start").cast("long").alias("start_at"), "due")


def meeting_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Promises of both sides with the date that follows within 80 characters."""
    rows, _ = _sentences(spark, sf_dir)
    whole = _transcripts(spark, sf_dir).select("doc_id", T.fold(F.col("text")).alias("whole"))
    after = F.substring("whole", (F.col("start") + 1).cast("int"), F.length("quote") + 80)
    rows = rows.join(whole, "doc_id").withColumn("after", after).drop("whole")
    found = X.tasks(rows, [Entry("task", OURS)], [Entry("task", THEIRS)], F.lit(MEETING))
    return found.select("doc_id", "side", "responsible", "due", F.col("start").cast("long").alias("start_at"), _digest("quote").alias("quote_md5"))


QUERIES = {
    f.__name__: f
    for f in (transcript_turns, speaker_roles, transcript_sentences, client_statements, client_objections, meeting_risks, product_status, meeting_deadlines, meeting_tasks)
}

_LIST = ", ".join(f"'{r}'" for r in REMARKS)
_TURNS = f"""
lines AS (
  SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn,
    CASE role WHEN 'assistant' THEN 'Ana' WHEN 'user' THEN 'Bruno' ELSE 'Carla' END AS speaker,
    CASE WHEN role = 'assistant' AND conv_id % 3 = 2 THEN 'Comercial' WHEN role = 'user' AND conv_id % 3 = 0 THEN 'Diretor' END AS title,
    coalesce(text, '') || replace([{_LIST}][(conv_id * 7 + conversations.turn) % {len(REMARKS)} + 1], '{{n}}', CAST((conv_id * 13 + conversations.turn * 5) % 90 + 10 AS VARCHAR)) AS said
  FROM conversations
), placed AS (
  SELECT *, CASE WHEN doc_id % 10 = 4 THEN '' ELSE speaker || CASE WHEN title IS NULL THEN '' ELSE ' (' || title || ')' END || ': ' END AS label FROM lines
), ranged AS (
  SELECT *, coalesce(sum(length(label || said) + 1) OVER (PARTITION BY doc_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS label_start,
    lead(turn) OVER (PARTITION BY doc_id ORDER BY turn) IS NULL AS is_last, doc_id % 10 <> 4 AND min(speaker) OVER (PARTITION BY doc_id) <> max(speaker) OVER (PARTITION BY doc_id) AS both_speak
  FROM placed
), turns AS (
  SELECT doc_id, turn, speaker, title, CAST(label_start + length(label) + length(said) - length(ltrim(said, ' ' || chr(10) || chr(9) || chr(13))) AS BIGINT) AS start_at,
    CAST(label_start + length(label || said) + CASE WHEN is_last THEN 0 ELSE 1 END AS BIGINT) AS end_at,
    regexp_replace(said, '^\\s+|\\s+$', '', 'g') AS text, {WORDS.format("said")} AS words
  FROM ranged WHERE both_speak
), docs AS (
  SELECT doc_id, string_agg(label || said, chr(10) ORDER BY turn) AS whole, bool_or(both_speak) AS diarised FROM ranged GROUP BY doc_id
), spans AS (
  SELECT doc_id, turn, speaker, start_at, text, words FROM turns
  UNION ALL SELECT doc_id, 0, NULL, 0, regexp_replace(whole, '\\s+$', ''), {WORDS.format("whole")} FROM docs WHERE NOT diarised
)"""


def _marks(patterns: tuple[tuple[str, str], ...]) -> str:
    return " + ".join(f"CASE WHEN regexp_matches(whole, '{p}') THEN 1 ELSE 0 END" for p, _ in patterns)


_ROLES = f"""{_TURNS}, spoken AS (
  SELECT doc_id, speaker, min(turn) AS first, max(title) AS title, {FOLD.replace("text", "string_agg(text, ' ' ORDER BY turn)")} AS whole,
    avg(CASE WHEN contains(text, '?') THEN 1 ELSE 0 END) AS rate, quantile_cont(words, 0.5) AS median
  FROM turns GROUP BY doc_id, speaker
), facing AS (
  SELECT *, rate - lead(rate) OVER (d ORDER BY rate DESC, first) AS gap, row_number() OVER (d ORDER BY rate DESC, first) AS rate_rank,
    row_number() OVER (d ORDER BY median DESC, first) AS long_rank, row_number() OVER (d ORDER BY median, first DESC) AS short_rank, max(median) OVER d AS longest, min(median) OVER d AS shortest
  FROM spoken WINDOW d AS (PARTITION BY doc_id)
), scored AS (
  SELECT *, rate_rank = 1 AND rate >= 0.5 AND gap > 0 AS asks, longest >= {R.LONG_TURN} AND shortest > 0 AND longest >= 1.5 * shortest AS apart FROM facing
), summed AS (
  SELECT *, CASE title WHEN 'Comercial' THEN {R.TITLE} WHEN 'Diretor' THEN -{R.TITLE} ELSE 0 END + {R.WORDS} * ({_marks(R.SELLER_MARKS)}) - {R.WORDS} * ({_marks(R.CLIENT_MARKS)})
    + CASE WHEN asks THEN gap * {R.QUESTIONS} ELSE 0 END + CASE WHEN apart AND long_rank = 1 THEN -{R.LENGTH} ELSE 0 END + CASE WHEN apart AND short_rank = 1 THEN {R.LENGTH} ELSE 0 END AS score
  FROM scored
), s1 AS (
  SELECT *, CASE WHEN score >= {R.THRESHOLD} THEN 'seller' WHEN score <= -{R.THRESHOLD} THEN 'client' ELSE 'unknown' END AS side,
    least(0.95, floor((1 - exp(-abs(score) / 2.5)) * 100 + 0.5) / 100) AS sure FROM summed
), s2 AS (
  SELECT * REPLACE (CASE WHEN elected THEN 'seller' ELSE side END AS side), CASE WHEN elected OR side <> 'unknown' THEN sure ELSE 0 END AS confidence
  FROM (SELECT *, NOT bool_or(side = 'seller') OVER (PARTITION BY doc_id) AND asks AND side = 'unknown' AND score > 0 AS elected FROM s1)
), s3 AS (
  SELECT * REPLACE (CASE WHEN side <> 'unknown' THEN side WHEN sold THEN 'client' WHEN bought AND unknowns = 1 THEN 'seller' ELSE side END AS side,
    CASE WHEN side = 'unknown' AND (sold OR bought AND unknowns = 1) THEN {R.PROPAGATED} ELSE confidence END AS confidence)
  FROM (SELECT *, bool_or(side = 'seller') OVER (PARTITION BY doc_id) AS sold, bool_or(side = 'client') OVER (PARTITION BY doc_id) AS bought, count(*) FILTER (WHERE side = 'unknown') OVER (PARTITION BY doc_id) AS unknowns FROM s2)
), s4 AS (
  SELECT * REPLACE (CASE WHEN last_resort THEN 'seller' ELSE side END AS side, CASE WHEN last_resort THEN {R.SPEAKING_ORDER} ELSE confidence END AS confidence) FROM (
    SELECT *, NOT bool_or(side = 'seller') OVER (PARTITION BY doc_id) AND row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, first) = 1 AS last_resort FROM s3)
), roles AS (
  SELECT doc_id, speaker, row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS position, score,
    CASE WHEN side = 'unknown' THEN 'client' ELSE side END AS side, CASE WHEN side = 'unknown' THEN {R.PROPAGATED} ELSE confidence END AS confidence FROM s4
), sides AS (SELECT doc_id, bool_or(side = 'client') AS attributable FROM roles GROUP BY doc_id)"""

_SHORT = "|".join(T.ABBREVIATIONS)
_CLOSERS = "[.!?\"''”’)\\]]*"
_SENTENCES = f"""{_ROLES}, cut AS (
  SELECT doc_id, turn, speaker, start_at, string_split(regexp_replace(regexp_replace(text, '([.!?]{_CLOSERS})(\\s+[\\p{{Lu}}0-9"''“—-])', '\\1' || chr(30) || '\\2', 'g'),
    '((?:^|[^\\p{{L}}])(?:(?i:{_SHORT})|\\p{{L}})\\.)' || chr(30), '\\1', 'g'), chr(30)) AS pieces FROM spans
), pieces AS (
  SELECT doc_id, turn, speaker, start_at, i, pieces[i] AS piece, coalesce(list_sum(list_transform(pieces[1:i - 1], lambda x: length(x))), 0) AS shift
  FROM (SELECT *, unnest(range(1, len(pieces) + 1)) AS i FROM cut)
), bare AS (
  SELECT *, regexp_replace(piece, '^\\s+|\\s+$', '', 'g') AS quote, length(piece) - length(regexp_replace(piece, '^\\s+', '')) AS lead FROM pieces
), sentences AS (
  SELECT b.doc_id, CAST(row_number() OVER (PARTITION BY b.doc_id ORDER BY b.turn, i) - 1 AS BIGINT) AS sentence_no, CAST(start_at + shift + lead AS BIGINT) AS start_at, side, b.speaker, quote,
    {FOLD.replace("text", "quote")} AS search, NOT coalesce(attributable, false) OR coalesce(side = 'client', false) AS client
  FROM bare b LEFT JOIN roles r ON r.doc_id = b.doc_id AND r.speaker = b.speaker LEFT JOIN sides x ON x.doc_id = b.doc_id WHERE length(quote) > 0
)"""


def _at(pattern: str, text: str = "search") -> str:
    """Where a pattern first stands in a text, from 0; null where it doesn't."""
    head = f"regexp_extract(' ' || {text} || ' ', '(?s)^(.*?[^\\p{{L}}\\p{{N}}])(?:{pattern})[^\\p{{L}}\\p{{N}}]', 1)"
    return f"nullif(length({head}), 0) - 1"


def _due(text: str) -> str:
    """The date that a folded text names, by the rules: a stated day, days, weeks, weekday, next week, month's end, next month."""
    day = f"'(?:^|[^0-9])([0-9]{{1,2}})/([0-9]{{1,2}})(?:/([0-9]{{4}}|[0-9]{{2}}))?(?:[^0-9]|$)'"
    part = lambda k: f"regexp_extract({text}, {day}, {k})"
    year = f"CASE length({part(3)}) WHEN 4 THEN {part(3)} WHEN 2 THEN '20' || {part(3)} ELSE '{MEETING.year}' END"
    small = " ".join(f"WHEN '{w}' THEN {n}" for w, n in X.SMALL_NUMBERS)
    words = "|".join(w for w, _ in X.SMALL_NUMBERS)

    def count(unit: str) -> str:
        n = f"regexp_extract(' ' || {text} || ' ', '[^\\p{{L}}\\p{{N}}]em\\s+([0-9]{{1,3}}|{words})\\s+{unit}[^\\p{{L}}\\p{{N}}]', 1)"
        return f"coalesce(try_cast({n} AS INTEGER), CASE {n} {small} END)"

    names = "|".join(w for w, _ in X.WEEKDAYS)
    said = f"regexp_extract(' ' || {text} || ' ', '[^\\p{{L}}\\p{{N}}_]({names})[^\\p{{L}}\\p{{N}}_]', 1)"
    target = " ".join(f"WHEN '{w}' THEN {i}" for i, (w, _) in enumerate(X.WEEKDAYS))
    meeting, today = f"DATE '{MEETING}'", MEETING.isoweekday() % 7
    return f"""coalesce(try_cast({year} || '-' || lpad({part(2)}, 2, '0') || '-' || lpad({part(1)}, 2, '0') AS DATE),
      {meeting} + {count("dias?")}, {meeting} + 7 * {count("semanas?")}, {meeting} + ((CASE {said} {target} END - {today} + 6) % 7 + 1)::INT,
      CASE WHEN {_has("semana que vem|proxima semana", text)} THEN {meeting} + 7 END, CASE WHEN {_has("(?:fim|final) do mes", text)} THEN last_day({meeting}) END,
      CASE WHEN {_has("mes que vem|proximo mes", text)} THEN CAST({meeting} + INTERVAL 1 MONTH AS DATE) END)"""


def _has(pattern: str, text: str) -> str:
    return f"regexp_matches(' ' || {text} || ' ', '[^\\p{{L}}\\p{{N}}](?:{pattern})[^\\p{{L}}\\p{{N}}]')"


def _around(at: str, size: str, before: int, after: int) -> str:
    return f"substr(search, greatest(0, {at} - {before}) + 1, {at} + {size} + {after} - greatest(0, {at} - {before}))"


def _statements(entries: list[Entry]) -> str:
    return " UNION ALL ".join(f"SELECT *, '{e.label}' AS label, CAST({e.weight} AS DOUBLE) AS weight, {_at(e.pattern)} AS found FROM sentences WHERE client" for e in entries)


_RIVALS = " UNION ALL ".join(
    f"SELECT *, '{e.label}' AS label, {_has(PAST, _around('found', str(len(e.label)), 90, 90))} AS was, {_has(ACTIVE, _around('found', str(len(e.label)), 90, 90))} AS now "
    f"FROM (SELECT *, {_at(e.pattern)} AS found FROM sentences) WHERE found IS NOT NULL"
    for e in RIVALS
)
_PAYROLL, _ERP = PRODUCTS[1], PRODUCTS[0]
_SPAN = _around("found", "size", 60, 60)

SQL = {
    "transcript_turns": f"WITH {_TURNS} SELECT doc_id, turn, speaker, title, start_at, end_at, md5(text) AS text_md5, words FROM turns",
    "speaker_roles": f"""WITH {_ROLES}
SELECT doc_id, speaker, position, side, round(confidence, 4) AS confidence, round(score, 6) AS score, attributable FROM roles JOIN sides USING (doc_id)""",
    "transcript_sentences": f"WITH {_SENTENCES} SELECT doc_id, sentence_no, start_at, side, md5(quote) AS quote_md5 FROM sentences",
    "client_statements": f"""WITH {_SENTENCES}
SELECT doc_id, label, weight, start_at + found AS start_at, md5(quote) AS quote_md5 FROM ({_statements(NEEDS)}) WHERE found IS NOT NULL AND len(regexp_split_to_array(trim(search), '\\s+')) >= 3""",
    "client_objections": f"""WITH {_SENTENCES}, h AS (
  SELECT *, substr(search, greatest(1, found - 21), least(22, found)) AS glued FROM (SELECT *, {_at(PRICE)} AS found FROM sentences WHERE client) WHERE found IS NOT NULL
)
SELECT doc_id, 'price' AS label, {_has(RESOLUTION, "substr(search, found + 1, 264)")} AS resolved, start_at + found AS start_at
FROM h WHERE NOT ({_has(DENIAL, "glued")} AND NOT contains(glued, ',')) AND NOT {_has(OTHER, "search")}""",
    "meeting_risks": f"""WITH {_SENTENCES}, r AS (
  SELECT doc_id, label, arg_max(NOT was AND now, rank) AS active, max(rank) AS rank
  FROM (SELECT *, CASE WHEN was THEN 1 WHEN now THEN 3 ELSE 2 END AS rank FROM ({_RIVALS})) GROUP BY doc_id, label
)
SELECT doc_id, label AS risk, CASE WHEN weight >= 20 THEN 'high' WHEN weight >= 14 THEN 'medium' ELSE 'low' END AS severity
FROM ({_statements([e for e in NEEDS if e.label in CHURN])}) WHERE found IS NOT NULL
UNION ALL SELECT doc_id, label, CASE rank WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END FROM r WHERE active""",
    "product_status": f"""WITH {_SENTENCES}, no AS (SELECT doc_id, bool_or({_has(REFUSAL, "search")}) AS refused FROM sentences WHERE client GROUP BY doc_id),
h AS (
  SELECT *, '{_PAYROLL.label}' AS label, '{_PAYROLL.group}' AS grp, {len("acme folha")} AS size FROM (SELECT *, {_at(_PAYROLL.pattern)} AS found FROM sentences) WHERE found IS NOT NULL
  UNION ALL SELECT * EXCLUDE (longer), '{_ERP.label}', '{_ERP.group}', {len("acme")} FROM (SELECT *, {_at(_ERP.pattern)} AS found, {_at(_PAYROLL.pattern)} AS longer FROM sentences) WHERE found IS NOT NULL AND longer IS NULL
), s AS (
  SELECT h.doc_id, label, grp, start_at + found AS start_at, CASE WHEN {_has(CONTEXTS["possession"], _SPAN)} THEN 1 WHEN {_has(CONTEXTS["evaluating"], _SPAN)} THEN 2
    WHEN {_has(CONTEXTS["opportunity"], _around("found", "size", 220, 220))} AND NOT coalesce(refused, false) THEN 3 ELSE 4 END AS rank
  FROM h LEFT JOIN no USING (doc_id)
)
SELECT doc_id, label, grp, ['in_use', 'evaluating', 'opportunity', 'mentioned'][rank] AS status, [0.9, 0.75, 0.75, 0.6][rank]::DOUBLE AS confidence, start_at
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY rank, start_at) AS k FROM s) WHERE k = 1""",
    "meeting_deadlines": f"""WITH {_SENTENCES}, due AS (SELECT doc_id, start_at, {_due("search")} AS due FROM sentences)
SELECT * FROM due WHERE due IS NOT NULL""",
    "meeting_tasks": f"""WITH {_SENTENCES}, folded AS (SELECT doc_id, {FOLD.replace("text", "whole")} AS folded FROM docs), h AS (
  SELECT *, 'ours' AS task_side FROM sentences WHERE {_has(OURS, "search")} UNION ALL SELECT *, 'theirs' FROM sentences WHERE {_has(THEIRS, "search")}
), a AS (SELECT h.*, substr(folded, start_at + 1, length(quote) + 80) AS after_text FROM h JOIN folded USING (doc_id) QUALIFY row_number() OVER (PARTITION BY h.doc_id, task_side, quote ORDER BY start_at) = 1)
SELECT doc_id, task_side AS side, speaker AS responsible, start_at, md5(quote) AS quote_md5, {_due("after_text")} AS due FROM a""",
}

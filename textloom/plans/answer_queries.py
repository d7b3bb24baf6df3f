"""Queries of spoken text, answer assembly and answer selection, each with the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import language as L
from textloom.functions import payload as P
from textloom.functions import spoken as S
from textloom.functions import text as T

from . import payload_queries
from .inputs import LINES, fixed, quoted, table, values
from .payload_queries import over
from .text_queries import squeeze, trim

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_docs, _turns, _events = ("documents", "doc_id", "text"), ("conversations", "conv_id * 1000 + turn", "text"), ("events", "event_id", "props")

SPOKEN_ROWS = (
    "[[spoken]]Hi ,there!!Now[[/spoken]] (laughs) <b>bold</b> [music] 3.5% of 20", "- dash -", "", "a.b.c,d", "Он сказал:да [смех]!! 42", "你好,世界 [笑声]。", "no change here.",
    "x (Pause) y ~ z", "one.Two?three", "3.14,2 and v1.2",
)
BODIES = (
    "# Head\nURL: http://x\nThe answer stands here.\n| a | b |\nAnswer: and goes on.", "Category: a | Question: b | Answer: It costs ten.", "Title: only\nSection: labels", "plain text",
    "[PDF: file | u]\nFAQ-A: yes", "", "Question: what?\nanswer : no",
)


def here(name: str, *args) -> None:
    """A query of `over` under this module's name."""
    over(name, *args)
    QUERIES[name], ORACLES[name] = payload_queries.QUERIES.pop(name), payload_queries.ORACLES.pop(name)


def sanitized_sql(x: str, digits: str = "") -> str:
    t = trim(x)
    for pattern, stand_in in S.CUTS:
        t = f"regexp_replace({t}, '{pattern}', '{stand_in}', 'g')"
    t = f"regexp_replace({t}, '[^{digits}{S.SPOKEN}\\s{S.MARKS}%/''’-]', ' ', 'g')"
    t = f"regexp_replace(regexp_replace({t}, '([{S.MARKS}]){{2,}}', '\\1', 'g'), '\\s+', ' ', 'g')"
    t = f"regexp_replace({t}, '\\s+([{S.MARKS}])', '\\1', 'g')"
    for _ in range(2):  # no lookaround here: neighbours that overlap need a second pass
        t = f"regexp_replace({t}, '(^|\\D)([{S.MARKS}])([^\\s{S.MARKS}\\d])', '\\1\\2 \\3', 'g')"
    return f"regexp_replace({t}, '^[ \\n\\t-]+|[ \\n\\t-]+$', '', 'g')"


here("sanitize_spoken", SPOKEN_ROWS + LINES, lambda x: S.sanitized(x, keep_digits=True), sanitized_sql("x", "0-9"), _turns)
here(
    "speakable_flags", SPOKEN_ROWS + LINES,
    lambda x: F.concat_ws(",", S.is_speakable(x).cast("string"), x.rlike("[0-9]").cast("string"), S.needs_rewrite(x).cast("string")),
    f"""concat_ws(',', regexp_matches({sanitized_sql('x')}, '[{S.SPOKEN}]')::VARCHAR, regexp_matches(x, '[0-9]')::VARCHAR, ({sanitized_sql('x')} <> '' AND {sanitized_sql('x')} <> {trim('x')})::VARCHAR)""",
    _turns,
)
_split = lambda x: f"list_filter(list_transform(string_split(regexp_replace({x}, '([.!?。！？])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {trim('s')}), lambda s: s <> '')"
_skey = lambda x: squeeze(f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g')")
here(
    "remaining_suffix", LINES, lambda x: S.remaining_suffix(x, F.array_join(F.slice(T.sentences(x), 1, 2), " ")),
    f"""CASE WHEN {trim('x')} = '' THEN '' ELSE array_to_string(list_filter({_split('x')}, lambda s: NOT list_contains(list_filter(list_transform({_split('x')}[1:2], lambda k: {_skey('k')}), lambda k: k <> ''), {_skey('s')})), ' ') END""",
    _docs,
)
_inline = f"""CASE WHEN regexp_matches(s, '(?i)^(Category|Question)\\s*:') AND contains(s, 'Answer:') THEN {trim("regexp_replace(s, '(?s)^.*?Answer:', '')")} ELSE s END"""
_bare = f"list_transform(list_transform(list_filter(list_transform(string_split(x, chr(10)), lambda s: {trim('s')}), lambda s: s <> ''), lambda s: {_inline}), lambda s: {trim('''regexp_replace(s, '(?i)^(?:Answer|FAQ-A)\\s*:\\s*', '')''')})"
_body = f"array_to_string(list_filter({_bare}, lambda s: s <> '' AND NOT regexp_matches(s, '(?i)^(URL|Title|Section|Category|Question)\\s*:') AND NOT regexp_matches(s, '^(#|\\[PDF|\\|)')), ' ')"
here("answer_body_text", BODIES + LINES, S.answer_body, f"CASE WHEN {trim(_body)} <> '' THEN {trim(_body)} ELSE {trim('x')} END", _turns)

#: Keys of an introduction's blocks, and short talk with its kind.
BLOCK_KEYS = {"kk": ("kk", "kaz", "kazakh", "qazaq"), "en": ("en", "eng", "english"), "ru": ("ru", "rus", "russian"), "general": ("general", "common", "other")}
TALK = {
    "greeting": ("hi", "hello", "hey", "good morning", "good afternoon", "привет", "здравствуйте", "добрый день", "сәлем", "сәлеметсіз бе", "қайырлы күн", "你好", "您好", "早上好", "晚上好"),
    "thanks": ("thanks", "thank you", "спасибо", "рахмет", "рақмет", "谢谢"),
    "goodbye": ("bye", "goodbye", "пока", "до свидания", "сау бол", "сау болыңыз", "再见", "拜拜"),
}
FALLBACKS = {
    "en": "Sorry, I found no reliable answer.", "ru": "Извините, надежного ответа нет.", "kk": "Кешіріңіз, сенімді жауап табылмады.", "zh": "抱歉，没有找到可靠答案。",
}
OVERVIEW_SPECIFIC = (
    "court", "fintech", "lab", "sandbox", "capital", "requirement", "requirements", "insurance", "intermediary", "broker", "firm", "firms", "license", "licensed", "licensing", "authorisation",
    "authorization", "rule", "rules", "regulation", "regulations", "register", "registration", "company", "participant", "participants", "visa", "tax", "dispute", "arbitration", "recognition",
    "market", "exchange",
)
OVERVIEW_WORDS = ("about", "overview", "intro", "introduction", "explain", "describe", "tell", "information", "info", "what")
ASKED = ("Hello!", "THANK you", "bye", "до свидания", "谢谢", "tell me about the report", "what is the report on tax", "the report", "hello there", "сау бол!", "information, report?", "about", "")


def alias(x: Column, names: dict[str, tuple[str, ...]]) -> Column:
    """The canonical name of a key, null if there is none."""
    k = F.replace(F.lower(T.trimmed(x)), F.lit("_"), F.lit("-"))
    out = F.lit(None).cast("string")
    for name, keys in names.items():
        out = F.when(k.isin(*keys), name).otherwise(out)
    return out


def said(x: str) -> str:
    return "(" + ", ".join(quoted(k) for k in x) + ")"


def by_name(key: str, names: dict) -> str:
    return "CASE " + " ".join(f"WHEN {key} IN {said(keys)} THEN {quoted(name)}" for name, keys in names.items()) + " END"


here("alias_lookup", ("KK", " eng", "Rus", "common", "x", "", "qazaq"), lambda x: alias(x, BLOCK_KEYS), by_name(f"replace(lower({trim('x')}), '_', '-')", BLOCK_KEYS), ("documents", "doc_id", "lang"))
here("smalltalk_lookup", ASKED, lambda x: alias(S.sentence_key(x), TALK), by_name(_skey("x"), TALK), _turns)

def fallback(lang: Column, messages: dict[str, str] = FALLBACKS) -> Column:
    """The message of a language, English where it has none."""
    out = F.lit(messages["en"])
    for k, v in messages.items():
        out = F.when(lang == k, v).otherwise(out)
    return out


here(
    "fallback_by_language", ("en", "ru", "kk", "zh", "de", ""), fallback,
    "CASE x " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in FALLBACKS.items()) + f" ELSE {quoted(FALLBACKS['en'])} END", ("documents", "doc_id", "lang"),
)


def is_overview(x: Column, subject: str) -> Column:
    """Asks about the subject as such: names it, no special matter, and a word that asks for an overview."""
    return T.let(
        F.regexp_extract_all(F.lower(x), F.lit("([a-z]+)"), F.lit(1)),
        lambda t: F.array_contains(t, subject) & ~F.arrays_overlap(t, F.array(*map(F.lit, OVERVIEW_SPECIFIC))) & F.arrays_overlap(t, F.array(*map(F.lit, OVERVIEW_WORDS))),
    )


_lw = "regexp_extract_all(lower(x), '[a-z]+')"
_list = lambda items: "[" + ", ".join(map(quoted, items)) + "]"
here("overview_query", ASKED, lambda x: is_overview(x, "report"), f"list_contains({_lw}, 'report') AND NOT list_has_any({_lw}, {_list(OVERVIEW_SPECIFIC)}) AND list_has_any({_lw}, {_list(OVERVIEW_WORDS)})", _turns)
here(
    "detect_language_ui", ASKED + ("сәлем достар", "жұмыс", "обычный текст", "ordinary"),
    lambda x: F.when(x.rlike("[一-鿿]"), "zh").when(F.lower(x).rlike("[әғқңөұүһі]|(сәлем|рахмет|рақмет|қалай|жоқ|иә|жұмыс|құжат)"), "kk").when(F.lower(x).rlike("[а-яё]"), "ru").otherwise("en"),
    "CASE WHEN regexp_matches(x, '[一-鿿]') THEN 'zh' WHEN regexp_matches(lower(x), '[әғқңөұүһі]|(сәлем|рахмет|рақмет|қалай|жоқ|иә|жұмыс|құжат)') THEN 'kk' WHEN regexp_matches(lower(x), '[а-яё]') THEN 'ru' ELSE 'en' END",
    _docs,
)
SOURCES = (
    '{"source_file": " a.md ", "domain": "d"}', '{"documentName": "n"}', '{"metadata": {"source_file": "m.md"}, "domain": "d"}', '{"metadata": {"section_title": "s"}}', '{"chunk_id": "c-1"}', "{}", "no json",
)
_keys = ("source_file", "metadata.source_file", "metadata.section_title", "documentName", "domain", "chunk_id")
_js = "CASE WHEN json_valid(x) THEN x END"
here(
    "chunk_source_label", SOURCES, lambda x: F.coalesce(P.first_text(x, _keys), F.lit("knowledge base")),
    "coalesce(" + ", ".join(f"nullif({trim(f'''json_extract_string({_js}, '$.{k}')''')}, '')" for k in _keys) + ", 'knowledge base')", _events,
)
MAGIC = ("52494646" + "00" * 90, "1a45dfa3" + "00" * 90, "4f676753" + "11" * 100, "494433" + "00" * 101, "00" * 100, "00" * 101, "00" * 20, "")


def sniffed(data: Column) -> Column:
    """File kind by a buffer's first bytes, and whether it can be 16-bit PCM."""
    h = F.hex(data)
    kind = F.when(h.startswith("52494646"), "wav").when(h.startswith("1A45DFA3"), "webm").when(h.startswith("4F676753"), "ogg").otherwise("bin")
    pcm = (F.octet_length(data) >= 80) & (F.octet_length(data) % 2 == 0) & (kind == "bin") & ~h.startswith("494433")
    return F.concat_ws(",", kind, pcm.cast("string"))


_hx = "upper(x)"
_kind = f"CASE WHEN starts_with({_hx}, '52494646') THEN 'wav' WHEN starts_with({_hx}, '1A45DFA3') THEN 'webm' WHEN starts_with({_hx}, '4F676753') THEN 'ogg' ELSE 'bin' END"
here("sniff_magic_bytes", MAGIC, lambda x: sniffed(F.unhex(x)), f"concat_ws(',', {_kind}, (length(x) >= 160 AND length(x) % 4 = 0 AND {_kind} = 'bin' AND NOT starts_with({_hx}, '494433'))::VARCHAR)", ("documents", "doc_id", "hex(text)"))
ORACLES["sniff_magic_bytes"] = ORACLES["sniff_magic_bytes"].replace("hex(text)", "hex(encode(text))")

DETAILS = (
    '{"summary": "S", "points": ["a", " ", "b"], "sections": [{"title": "T", "text": "x", "items": ["i", "j"]}, {"title": "", "text": "", "items": []}]}',
    '{"points": ["1", "2", "3", "4", "5", "6", "7"], "sections": [{"title": "A", "text": "", "items": ["1", "2", "3", "4", "5"]}, {"title": "B", "text": "b", "items": []}, {"title": "C", "text": "c", "items": ["z"]}]}',
    '{"summary": " only "}', "{}", '{"sections": [{"title": "", "text": "t", "items": []}]}',
)
DETAILS_TYPE = "struct<summary:string,points:array<string>,sections:array<struct<title:string,text:string,items:array<string>>>>"
MOST_POINTS, MOST_SECTIONS, MOST_ITEMS = 5, 2, 4
_some = lambda a: F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), T.trimmed), lambda x: x != "")
_text = lambda x: T.trimmed(F.coalesce(x, F.lit("")))


def limited(d: Column) -> Column:
    """An answer's details within their caps: points, sections that hold something, and their items."""
    sections = F.transform(
        F.coalesce(d["sections"], F.array().cast("array<struct<title:string,text:string,items:array<string>>>")),
        lambda s: F.struct(_text(s["title"]).alias("title"), _text(s["text"]).alias("text"), F.slice(_some(s["items"]), 1, MOST_ITEMS).alias("items")),
    )
    filled = F.filter(sections, lambda s: (s["title"] != "") | (s["text"] != "") | (F.size(s["items"]) > 0))
    return F.struct(_text(d["summary"]).alias("summary"), F.slice(_some(d["points"]), 1, MOST_POINTS).alias("points"), F.slice(filled, 1, MOST_SECTIONS).alias("sections"))


def as_markdown(d: Column) -> Column:
    """Summary, points, and sections with their items as bullets."""
    lines = lambda s: F.concat(
        F.array(F.when(_text(s["title"]) != "", F.concat(F.lit("### "), _text(s["title"]))).otherwise("")), F.array(_text(s["text"])), F.transform(_some(s["items"]), lambda i: F.concat(F.lit("- "), i))
    )
    every = F.concat(F.array(_text(d["summary"])), _some(d["points"]), F.flatten(F.transform(F.coalesce(d["sections"], F.array().cast("array<struct<title:string,text:string,items:array<string>>>")), lines)))
    return F.array_join(F.filter(every, lambda x: x != ""), "\n")


#: Details made of turns: what Spark and DuckDB write as JSON.
_POINTS = ("split(left(text, 300), '[.] ')", "regexp_split_to_array(left(text, 300), '[.] ')")
DETAIL_ROWS = (
    "conversations", "conv_id * 1000 + turn",
    f"""to_json(named_struct('summary', CASE WHEN turn % 3 = 0 THEN ' ' ELSE left(text, 60) END, 'points', CASE WHEN turn % 2 = 0 THEN {_POINTS[0]} END,
      'sections', array(named_struct('title', role, 'text', CASE WHEN conv_id % 2 = 0 THEN left(text, 40) ELSE '' END, 'items', {_POINTS[0]}), named_struct('title', '', 'text', '', 'items', array('')),
        named_struct('title', 'Last', 'text', ' t ', 'items', array('i'))), 'answer_kind', role, 'confidence', CASE WHEN turn < 3 THEN cast(turn AS string) END))""",
    f"""to_json({{'summary': CASE WHEN turn % 3 = 0 THEN ' ' ELSE left(text, 60) END, 'points': CASE WHEN turn % 2 = 0 THEN {_POINTS[1]} END,
      'sections': [{{'title': role, 'text': CASE WHEN conv_id % 2 = 0 THEN left(text, 40) ELSE '' END, 'items': {_POINTS[1]}}}, {{'title': '', 'text': '', 'items': ['']}},
        {{'title': 'Last', 'text': ' t ', 'items': ['i']}}], 'answer_kind': role, 'confidence': CASE WHEN turn < 3 THEN turn::VARCHAR END}})::VARCHAR""",
)
_dj = lambda d: F.from_json(d, DETAILS_TYPE)
_d = "from_json(x, '{\"summary\":\"VARCHAR\",\"points\":[\"VARCHAR\"],\"sections\":[{\"title\":\"VARCHAR\",\"text\":\"VARCHAR\",\"items\":[\"VARCHAR\"]}]}')"
_dsome = lambda a: f"list_filter(list_transform(coalesce({a}, []), lambda v: {trim('v')}), lambda v: v <> '')"
_dt = lambda a: trim(f"coalesce({a}, '')")
here(
    "details_to_markdown", DETAILS, lambda x: as_markdown(_dj(x)),
    f"""array_to_string(list_filter(list_concat([{_dt(f'({_d}).summary')}], {_dsome(f'({_d}).points')}, flatten(list_transform(coalesce(({_d}).sections, []),
      lambda s: list_concat([CASE WHEN {_dt('s.title')} <> '' THEN '### ' || {_dt('s.title')} ELSE '' END, {_dt('s.text')}], list_transform({_dsome('s.items')}, lambda i: '- ' || i))))), lambda v: v <> ''), chr(10))""", DETAIL_ROWS,
)
here(
    "limit_details", DETAILS, lambda x: T.let(limited(_dj(x)), lambda d: F.concat_ws("¦", F.array_join(d["points"], "|"), F.array_join(F.transform(d["sections"], lambda s: F.concat_ws(":", s["title"], s["text"], F.array_join(s["items"], "+"))), "|"))),
    f"""concat_ws('¦', array_to_string({_dsome(f'({_d}).points')}[1:{MOST_POINTS}], '|'), array_to_string(list_transform(list_filter(list_transform(coalesce(({_d}).sections, []),
      lambda s: {{'t': {_dt('s.title')}, 'x': {_dt('s.text')}, 'i': {_dsome('s.items')}[1:{MOST_ITEMS}]}}), lambda s: s.t <> '' OR s.x <> '' OR len(s.i) > 0)[1:{MOST_SECTIONS}],
      lambda s: concat_ws(':', s.t, s.x, array_to_string(s.i, '+'))), '|'))""", DETAIL_ROWS,
)
QUERIES_ROWS = ('["a", " b ", "", "c", "d"]', "[]", '["", " "]')
here(
    "cache_put_projection", QUERIES_ROWS, lambda x: T.let(F.array_join(F.filter(F.transform(F.slice(F.from_json(x, "array<string>"), 1, 3), T.trimmed), lambda q: q != ""), " ; "), lambda j: F.when(j != "", j).otherwise("query")),
    f"""coalesce(nullif(array_to_string(list_filter(list_transform(from_json(x, '["VARCHAR"]')[1:3], lambda q: {trim('q')}), lambda q: q <> ''), ' ; '), ''), 'query')""",
    ("conversations", "conv_id * 1000 + turn", f"to_json({_POINTS[0]})", f"to_json({_POINTS[1]})::VARCHAR"),
)

# A summary of one sentence: query words shared, and a little for the chunk's place.
_words = lambda x: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(x), F.lit("([a-z0-9]+)"), F.lit(1)), lambda w: F.length(w) > 2))


def extractive_summary(queries, chunks, most_words: int = 52):
    """query_id and summary: the best sentence of a query's chunks (query_id, pos, text). Queries: query_id, text."""
    q = queries.select("query_id", _words(F.col("text")).alias("q"))
    s = chunks.filter("pos < 5").select("query_id", "pos", F.posexplode(F.slice(T.sentences(S.answer_body(F.col("text"))), 1, 8)).alias("k", "sentence"))
    scored = s.join(q, "query_id").withColumn("words", _words(F.col("sentence"))).filter(F.size("words") > 0)
    score = F.size(F.array_intersect("q", "words")) / F.greatest(F.size("q"), F.lit(1)) + 0.04 * (5 - F.col("pos"))
    spoken = scored.withColumn("score", F.round(score, 9)).withColumn("spoken", S.sanitized(F.col("sentence"), keep_digits=True)).filter(F.size(F.split("spoken", r"\s+")) >= 4)
    best = spoken.groupBy("query_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "pos", "k", "spoken")).alias("b"))
    return best.select("query_id", S.capped(F.col("b.spoken"), most_words).alias("summary"))


def _summaries(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    own = W.partitionBy("conv_id").orderBy("turn")
    queries = turns.withColumn("r", F.row_number().over(own)).filter("r = 1").select(F.col("conv_id").alias("query_id"), "text")
    chunks = turns.withColumn("pos", F.row_number().over(own) - 2).filter("pos >= 0").select(F.col("conv_id").alias("query_id"), F.col("pos").cast("bigint").alias("pos"), "text")
    return extractive_summary(queries, chunks)


QUERIES["extractive_summary"] = _summaries
_tw = lambda x: f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: length(w) > 2))"
ORACLES["extractive_summary"] = f"""WITH t AS (SELECT conv_id AS query_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 2 AS pos FROM conversations),
  q AS (SELECT query_id, {_tw('text')} AS q FROM t WHERE pos = -1), c AS (SELECT query_id, pos, text AS x FROM t WHERE pos BETWEEN 0 AND 4),
  b AS (SELECT query_id, pos, CASE WHEN {trim(_body)} <> '' THEN {trim(_body)} ELSE {trim('x')} END AS body FROM c),
  s AS (SELECT query_id, pos, generate_subscripts(l, 1) - 1 AS k, unnest(l) AS s FROM (SELECT query_id, pos, {_split('body')}[1:8] AS l FROM b)),
  r AS (SELECT query_id, pos, k, {sanitized_sql('s', '0-9')} AS spoken, round(len(list_intersect(q, {_tw('s')}))::DOUBLE / greatest(len(q), 1) + 0.04::DOUBLE * (5 - pos), 9) AS score
    FROM s JOIN q USING (query_id) WHERE len({_tw('s')}) > 0),
  one AS (SELECT query_id, regexp_split_to_array(spoken, '\\s+') AS w, spoken FROM r WHERE len(regexp_split_to_array(spoken, '\\s+')) >= 4
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos, k) = 1)
  SELECT query_id, CASE WHEN len(w) > 52 THEN regexp_replace(array_to_string(w[1:52], ' '), '[ ,;:]+$', '') || '.' ELSE spoken END AS summary FROM one"""


def intro_buckets(texts, id_col: str = "doc_id", text_col: str = "text"):
    """Paragraphs of a text by language; after the first Russian one what is neither Kazakh nor Russian is general."""
    parts = texts.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, r"\n\s*\n+", -1)).alias("pos", "part")).withColumn("part", T.trimmed(F.col("part"))).filter("part <> ''")
    lang = F.when(F.col("part").rlike(f"[{L.KAZAKH_LETTERS}]"), "kk").when(F.col("part").rlike("[А-Яа-яЁё]"), "ru").otherwise("en")
    seen = F.coalesce(F.max(F.col("lang") == "ru").over(W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
    return parts.withColumn("lang", lang).withColumn("bucket", F.when((F.col("lang") == "en") & seen, "general").otherwise(F.col("lang"))).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "bucket", "part")


INTROS = ("Hello.\n\nСәлем, қалай.\n\nПривет.\n\nSecond English.\n \n\nЕщё.", "one\n\ntwo", "", "Русский\n\nlatin")
QUERIES["intro_buckets"] = lambda spark, sf_dir: intro_buckets(fixed(spark, INTROS).select((-F.col("n") - 1).alias("doc_id"), F.col("x").alias("text")).union(table(spark, sf_dir, "documents").select("doc_id", "text")))
ORACLES["intro_buckets"] = f"""WITH d AS (SELECT -n - 1 AS doc_id, x AS text FROM {values(INTROS)} UNION ALL SELECT doc_id, text FROM documents),
  p AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS part FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n\\s*\\n+', chr(1), 'g'), chr(1)) AS l FROM d)),
  l AS (SELECT doc_id, pos, {trim('part')} AS part, CASE WHEN regexp_matches(part, '[{L.KAZAKH_LETTERS}]') THEN 'kk' WHEN regexp_matches(part, '[А-Яа-яЁё]') THEN 'ru' ELSE 'en' END AS lang FROM p WHERE {trim('part')} <> '')
  SELECT doc_id, pos, part, CASE WHEN lang = 'en' AND coalesce(bool_or(lang = 'ru') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN 'general' ELSE lang END AS bucket FROM l"""


def detail_sections(texts):
    """doc_id, section, title, text and items of details (doc_id, text): titles begin with #, items with a dash."""
    order = W.partitionBy("doc_id").orderBy("pos")
    lines = texts.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("line", T.trimmed(F.col("line"))).filter("line <> ''")
    title = F.regexp_extract("line", r"^#{1,6}\s+(.+)$", 1)
    lines = lines.withColumn("title", F.when(title != "", title)).withColumn("section", F.sum(F.col("title").isNotNull().cast("int")).over(order))
    item = F.when(F.col("title").isNull() & F.col("line").startswith("-"), T.trimmed(F.regexp_replace("line", "^[- ]+", "")))
    prose = F.when(F.col("title").isNull() & ~F.col("line").startswith("-"), F.col("line"))
    joined = lambda c, sep: F.array_join(F.transform(F.array_sort(F.filter(F.collect_list(F.struct("pos", c.alias("v"))), lambda x: x["v"].isNotNull())), lambda x: x["v"]), sep)
    out = lines.groupBy("doc_id", "section").agg(F.coalesce(F.max("title"), F.lit("Details")).alias("title"), joined(prose, " ").alias("text"), joined(item, "|").alias("items"))
    return out.filter("text <> '' or items <> ''").select("doc_id", F.col("section").cast("bigint").alias("section"), "title", "text", "items")


NOTES = ("First words.\n- one\n- two\n# Fees\nThey are low.\n-  three\n\n## Empty\n### Last\nmore\nand more", "# Only", "", "- item")
QUERIES["detail_sections"] = lambda spark, sf_dir: detail_sections(fixed(spark, NOTES).select((-F.col("n") - 1).alias("doc_id"), F.col("x").alias("text")).union(table(spark, sf_dir, "documents").select("doc_id", "text")))
_lt = "regexp_extract(line, '^#{1,6}\\s+(.+)$', 1)"
ORACLES["detail_sections"] = f"""WITH d AS (SELECT -n - 1 AS doc_id, x AS text FROM {values(NOTES)} UNION ALL SELECT doc_id, text FROM documents),
  l AS (SELECT doc_id, pos, {trim('line')} AS line FROM (SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM d))),
  t AS (SELECT *, nullif({_lt}, '') AS title, sum((nullif({_lt}, '') IS NOT NULL)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM l WHERE line <> '')
  SELECT doc_id, section::BIGINT AS section, coalesce(max(title), 'Details') AS title, coalesce(string_agg(line, ' ' ORDER BY pos) FILTER (WHERE title IS NULL AND NOT starts_with(line, '-')), '') AS text,
    coalesce(string_agg({trim("regexp_replace(line, '^[- ]+', '')")}, '|' ORDER BY pos) FILTER (WHERE title IS NULL AND starts_with(line, '-')), '') AS items
  FROM t GROUP BY doc_id, section HAVING count(*) FILTER (WHERE title IS NULL) > 0"""


def prompt_context(turns, last: int = 6):
    """The last turns of each conversation in order, with their roles."""
    recent = turns.withColumn("r", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))).filter(F.col("r") <= last)
    parts = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.initcap("role"), F.lit(": "), F.col("text")).alias("t"))))
    return recent.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("context"))


QUERIES["prompt_context"] = lambda spark, sf_dir: prompt_context(table(spark, sf_dir, "conversations"))
ORACLES["prompt_context"] = """SELECT conv_id, string_agg(concat(upper(role[1]), lower(role[2:]), ': ', text), chr(10) ORDER BY turn) AS context
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 6 GROUP BY conv_id"""

#: The name space of addresses, RFC 4122.
ADDRESSES = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column) -> Column:
    """UUID of version 5 in the name space of addresses."""
    h = F.lower(F.sha1(F.concat(F.unhex(F.lit(ADDRESSES)), F.encode(name, "UTF-8"))))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


QUERIES["point_id_uuid5"] = lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", uuid5(F.left("text", F.lit(120))).alias("point_id"))
_h = f"sha1(from_hex('{ADDRESSES}') || encode(left(text, 120)))"
ORACLES["point_id_uuid5"] = f"""SELECT doc_id, concat_ws('-', h[1:8], h[9:12], '5' || h[14:16], ('89ab')[(strpos('0123456789abcdef', h[17:17]) - 1) % 4 + 1] || h[18:20], h[21:32]) AS point_id
  FROM (SELECT doc_id, {_h} AS h FROM documents)"""

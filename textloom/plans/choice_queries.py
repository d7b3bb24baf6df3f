"""Queries of choosing an answer, its details, content nodes and the vector index, with DuckDB SQL or expected rows."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from textloom.functions import answers as A
from textloom.functions import language as L
from textloom.functions import nodes as N
from textloom.functions import payload as P
from textloom.functions import text as T
from textloom.operators import matching, vectors
from textloom.sources import shared

from . import language_queries as G
from .answer_queries import ASKED, DETAIL_ROWS, DETAILS, OVERVIEW_SPECIFIC, OVERVIEW_WORDS, TALK, alias, by_name, is_overview, sanitized_sql
from .inputs import fixed, quoted, table, values
from .text_queries import squeeze, trim

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def expected(rows: tuple[str | None, ...]) -> str:
    """SQL for the rows (n, value), numbered from 0."""
    return "SELECT * FROM (VALUES " + ", ".join(f"({k}::BIGINT, {'NULL' if x is None else quoted(x)}::VARCHAR)" for k, x in enumerate(rows)) + ") v(n, value)"


WRAPPED = ('see {"a": {"b": "}"}} and {"c": 1}', '{broken} then {"ok": [1, 2]}', "none", '{"open": ', 'x {} {"y": 1}', "")
FOUND = ('{"a": {"b": "}"}}', '{"ok": [1, 2]}', None, None, "{}", None)
QUERIES["json_extract_balanced"] = lambda spark, sf_dir: fixed(spark, WRAPPED).union(table(spark, sf_dir, "events").select((F.col("event_id") + 1000).alias("n"), F.concat(F.lit("event {it} has "), "props"))).select("n", N.balanced_json(F.col("x")).alias("value"))
ORACLES["json_extract_balanced"] = expected(FOUND) + " UNION ALL SELECT event_id + 1000, CASE WHEN json_valid(props) AND starts_with(props, '{') THEN props END FROM events"

NODES = tuple(
    json.dumps(x)
    for x in (
        [{"type": "header", "tag": "H3", "text": " Fees "}, {"type": "header", "tag": "x", "text": "Odd"}, {"type": "text", "text": "Plain words."}, {"type": "text", "text": " "}],
        [{"type": "list", "items": ["one", {"text": "two"}, "", {"items": ["three", {"text": "four"}]}]}, {"type": "file_attachment", "text": "Form", "url": "http://f"}, {"type": "file_attachment", "text": "PDF", "url": "u"}],
        [{"type": "table", "data": [["a", {"text": "b  c"}], ["lone"], ["four long words here stand"], ["Download", "x"]]}, {"type": "faq", "question": "Why?", "answer": "So."}, {"type": "faq", "question": "No answer"}],
        ["not a node", {"type": "other", "text": "t"}], [],
    )
) + ("no json",)
NODE_LINES = ("[H3] Fees¦[H2] Odd¦Plain words.", "- one¦- two¦- three four¦[PDF: Form | http://f]", "a | b c¦four long words here stand¦Q: Why?¦A: So.", "", "", "")
#: The fields of nodes made of pages: a header, a text, a list, a table, an attachment and a question.
_plain = "trim(left(regexp_replace(html, '[^A-Za-z]+', ' '{0}), 60))"
PAGE_NODES = tuple(
    x.replace("@", _plain.format(""))
    for x in (
        "'type', 'header', 'tag', concat('H', page_id % 8), 'text', concat(' Page ', page_id)", "'type', 'text', 'text', @", "'type', 'list', 'items', split(@, ' ')",
        "'type', 'table', 'data', array(array(concat('p', page_id), ' b  c', 'Download'), array('lone'), split(@, ' '))",
        "'type', 'file_attachment', 'text', CASE WHEN page_id % 3 = 0 THEN 'PDF' ELSE 'Form' END, 'url', url", "'type', 'faq', 'question', 'Which page?', 'answer', CASE WHEN page_id % 2 = 0 THEN url END",
    )
)


def _page_nodes(spark, sf_dir):
    each = ", ".join(f"to_json(named_struct({x}))" for x in PAGE_NODES)
    rows = table(spark, sf_dir, "pages").select((-F.col("page_id") - 1).alias("n"), F.expr(f"concat('[', concat_ws(',', {each}), ']')").alias("x"))
    return fixed(spark, NODES).union(rows).select("n", F.replace(N.rendered(F.col("x")), F.lit("\n"), F.lit("¦")).alias("value"))


QUERIES["render_json_nodes"] = _page_nodes
_w = _plain.format(", 'g'")
ORACLES["render_json_nodes"] = expected(NODE_LINES) + f""" UNION ALL SELECT -page_id - 1, concat_ws('¦', concat('[H', CASE WHEN page_id % 8 BETWEEN 1 AND 6 THEN page_id % 8 ELSE 2 END, '] Page ', page_id), nullif(t, ''),
    nullif(array_to_string(list_transform(list_filter(w, lambda x: x <> ''), lambda x: '- ' || x), '¦'), ''), concat('p', page_id, ' | b c'),
    CASE WHEN len(kept) >= 2 OR len(regexp_extract_all(array_to_string(kept, ' '), '[A-Za-z]{{3,}}')) >= 4 THEN array_to_string(kept, ' | ') END,
    CASE WHEN page_id % 3 > 0 THEN concat('[PDF: Form | ', {trim('url')}, ']') END, CASE WHEN page_id % 2 = 0 THEN concat('Q: Which page?¦A: ', {trim('url')}) END)
  FROM (SELECT *, list_filter(w, lambda x: x <> '' AND lower(x) NOT IN ('download', 'data', '(data)', 'form available')) AS kept FROM (SELECT page_id, url, {_w} AS t, string_split({_w}, ' ') AS w FROM pages)) x"""

SOURCED = tuple(
    json.dumps(x)
    for x in (
        ["The fee is one hundred.", "The fee is one hundred. It is paid once in every year. Short one here.", "It is paid once in every year. The form can be sent by post or online.", "A fourth source has this plain sentence. Another sentence stands after it too."],
        ["", "With nothing spoken there are no points."], ["Only an answer. It has a second sentence. And a third one."],
        ["Answer.", "The value here is null and void today. Fees are due within ten days for 12. This sentence ends on a word of"],
    )
)
_p = ("It is paid once in every year.", "The form can be sent by post or online.", "A fourth source has this plain sentence.")
POINTS = ("¦".join(_p), "", "", "Fees are due within ten days.")
_tagged = lambda said, details: f"[[spoken]]{said}[[/spoken]][[details]]{details}[[/details]]"
CANDIDATES = (
    _tagged("The fee is one hundred.", "The fee is one hundred.\n\n## Relevant details\n- " + "\n- ".join(_p)), _tagged("", ""),
    _tagged("Only an answer. It has a second sentence.", "Only an answer. It has a second sentence. And a third one."), _tagged("Answer.", "Answer.\n\n## Relevant details\n- Fees are due within ten days."),
)


def _sourced(spark, sf_dir, make):
    """The fixed answers with their sources; and assistants' turns, of which the start is the answer, and it, the whole turn
    and the turn before are the sources."""
    parts = F.from_json("x", "array<string>")
    own = fixed(spark, SOURCED).select("n", F.get(parts, F.lit(0)).alias("answer"), F.slice(parts, 2, 100).alias("bodies"))
    turns = table(spark, sf_dir, "conversations")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    start = F.left("text", F.lit(120))
    turns = turns.filter("role = 'assistant'").join(before, ["conv_id", "turn"], "left").select(
        (-F.col("conv_id") * 1000 - F.col("turn") - 1).alias("n"), start.alias("answer"), F.array(start, F.col("text"), F.coalesce("before", F.lit(""))).alias("bodies")
    )
    return own.union(turns).select("n", make(F.col("answer"), F.col("bodies")).alias("value"))


def _points_sql(shown: str, said: str) -> str:
    """The same for the turns, whose texts have no labels or headings."""
    split = lambda x: f"list_filter(list_transform(string_split(regexp_replace({x}, '([.!?。！？])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {trim('s')}), lambda s: s <> '')"
    body = lambda x: f"array_to_string(list_filter(list_transform(string_split({x}, chr(10)), lambda l: {trim('l')}), lambda l: l <> ''), ' ')"
    words_of = lambda x: f"regexp_split_to_array({trim(x)}, '\\s+')"
    capped = lambda x, n: f"CASE WHEN len({words_of(x)}) > {n} THEN concat(regexp_replace(array_to_string({words_of(x)}[1:{n}], ' '), '[ ,;:]+$', ''), '.') ELSE {trim(x)} END"
    key = lambda x: trim(f"regexp_replace(lower({x}), '{L.NOT_WORD}', ' ', 'g')")
    cut = squeeze(f"regexp_replace({capped('c', A.MOST_WORDS)}, '\\s+for\\s+[0-9]+\\.?$', '.')")
    bad = f"regexp_matches(c, '(?i)\\b(undefined|nan|null)\\b') OR (len(regexp_split_to_array(c, '\\s+')) > {A.MOST_WORDS} AND len(regexp_extract_all(c, ';')) >= 3)"
    first = f"{{'seen': [{key(said)}], 'p': []::VARCHAR[]}}"
    fold = f"""list_reduce(list_prepend({first}, list_transform(list_filter(fit, lambda x: x.k <> '' AND len(regexp_split_to_array(x.p, '\\s+')) >= {A.LEAST_WORDS}), lambda x: {{'seen': [x.k], 'p': [x.p]}})),
      lambda acc, itm: CASE WHEN len(list_filter(acc.seen, lambda s: contains(s, itm.seen[1]) OR contains(itm.seen[1], s))) > 0 OR len(acc.p) >= {A.MOST_POINTS} THEN acc
        ELSE {{'seen': list_concat(acc.seen, itm.seen), 'p': list_concat(acc.p, itm.p)}} END).p"""
    two = "array_to_string(two, ' ')"
    return f"""WITH a AS (SELECT -c.conv_id * 1000 - c.turn - 1 AS n, left(c.text, 120) AS answer, c.text, coalesce(b.text, '') AS before FROM conversations c
    LEFT JOIN conversations b ON b.conv_id = c.conv_id AND b.turn = c.turn - 1 WHERE c.role = 'assistant'),
  s AS (SELECT n, answer, {sanitized_sql('answer', '0-9')} AS whole, list_concat({split(body('answer'))}[1:{A.MOST_SENTENCES}], {split(body('text'))}[1:{A.MOST_SENTENCES}], {split(body('before'))}[1:{A.MOST_SENTENCES}]) AS l FROM a),
  e AS (SELECT n, i, {sanitized_sql('x', '0-9')} AS c FROM (SELECT n, generate_subscripts(l, 1) AS i, unnest(l) AS x FROM s)),
  d AS (SELECT n, i, CASE WHEN {bad} THEN '' ELSE {cut} END AS p FROM e),
  f AS (SELECT n, list({{'p': p, 'k': {key('p')}}} ORDER BY i) AS fit FROM (SELECT n, i, CASE WHEN regexp_matches(p, '(?i)\\b(and|or|for|of|with|to|in)\\.?$') THEN '' ELSE p END AS p FROM d) GROUP BY n),
  g AS (SELECT s.n, answer, whole, coalesce(fit, []) AS fit, {split('whole')}[1:2] AS two FROM s LEFT JOIN f ON f.n = s.n),
  z AS (SELECT n, whole, {fold} AS points, two FROM g),
  y AS (SELECT *, {capped(two, 40)} AS said FROM z)
  SELECT n, {shown} AS value FROM y"""


_joined = "array_to_string(points, '¦')"
_details = "concat(whole, CASE WHEN len(points) > 0 THEN concat(chr(10), chr(10), '## Relevant details', chr(10), '- ', array_to_string(points, concat(chr(10), '- '))) ELSE '' END)"
_shown = f"concat('[[spoken]]', {trim('said')}, '[[/spoken]][[details]]', CASE WHEN {trim(_details)} <> '' THEN {trim(_details)} ELSE {trim('said')} END, '[[/details]]')"
QUERIES["detail_points"] = lambda spark, sf_dir: _sourced(spark, sf_dir, lambda a, b: F.array_join(A.points(a, b), "¦"))
ORACLES["detail_points"] = f"SELECT * FROM ({expected(POINTS)}) UNION ALL SELECT * FROM ({_points_sql(_joined, 'answer')})"
QUERIES["candidate_projection"] = lambda spark, sf_dir: _sourced(spark, sf_dir, A.candidate)
ORACLES["candidate_projection"] = f"SELECT * FROM ({expected(CANDIDATES)}) UNION ALL SELECT * FROM ({_points_sql(_shown, 'whole')})"

KEPT = DETAILS + ('{"answer_kind": "Clarify", "confidence": 3, "summary": " s "}', '{"sections": [{"title": "t", "items": [" i ", "k"]}], "confidence": "x"}', "no json")
ENFORCED = (
    "S¦a|b¦answer¦0.86", "b¦1|2|3|4|5|6|7¦answer¦0.86", "only¦only¦answer¦0.86", "¦¦answer¦0.86", "t¦t¦answer¦0.86", "s¦s¦clarify¦1.0", "i¦i|k¦answer¦0.86", "¦¦answer¦0.86",
)
ENFORCED = (ENFORCED[0], "1¦" + ENFORCED[1].split("¦", 1)[1], *ENFORCED[2:])

def _kept(spark, sf_dir):
    of, key, body, _ = DETAIL_ROWS
    return fixed(spark, KEPT).union(table(spark, sf_dir, of).select((-F.expr(key) - 1).alias("n"), F.expr(body).alias("x")))


QUERIES["enforce_details"] = lambda spark, sf_dir: _kept(spark, sf_dir).withColumn("d", A.enforced(F.col("x"))).select(
    "n", F.concat_ws("¦", "d.summary", F.array_join("d.points", "|"), "d.answer_kind", F.col("d.confidence").cast("string")).alias("value")
)
_items = f"list_filter(list_transform(items, lambda v: {trim('v')}), lambda v: v <> '')"
# The turns' details by their parts: three sections, of which the second is empty and the last holds `t` and `i`.
ORACLES["enforce_details"] = f"""SELECT * FROM ({expected(ENFORCED)}) UNION ALL SELECT n, concat_ws('¦', summary, array_to_string(CASE WHEN len(own) > 0 THEN own ELSE listed END, '|'), CASE WHEN lower(role) IN {P.ANSWER_KINDS} THEN lower(role) ELSE 'answer' END,
    (CASE WHEN turn < 3 THEN least(1.0, turn) ELSE {P.DEFAULT} END)::DOUBLE::VARCHAR) FROM (
  SELECT -(conv_id * 1000 + turn) - 1 AS n, role, turn, CASE WHEN turn % 3 > 0 AND {trim('left(text, 60)')} <> '' THEN {trim('left(text, 60)')} ELSE coalesce(nullif(CASE WHEN {trim('part')} <> '' THEN {trim('part')} ELSE {trim('items[1]')} END, ''), 't') END AS summary,
    CASE WHEN turn % 2 = 0 THEN {_items} ELSE [] END AS own, list_concat({_items}, CASE WHEN {trim('part')} <> '' THEN [{trim('part')}] ELSE [] END, ['i', 't']) AS listed
  FROM (SELECT *, regexp_split_to_array(left(text, 300), '[.] ') AS items, CASE WHEN conv_id % 2 = 0 THEN left(text, 40) ELSE '' END AS part FROM conversations))"""


def final_turns(turns, require_signal: bool = False):
    """id and whether the turn (id, u) is complete. Its two plain forms are made once, in rows of their own."""
    forms = F.struct(T.squeezed(F.lower("u")).alias("plain"), T.query_signature(F.col("u")).alias("signature"))
    rows = turns.select("id", F.explode(F.array(forms)).alias("f")).select("id", "f.*")
    return rows.select("id", A.is_final_turn(F.col("plain"), F.col("signature"), alias(F.col("signature"), TALK).isNotNull(), require_signal).alias("value"))


QUERIES["final_turn_candidate"] = lambda spark, sf_dir: final_turns(G.utterances(spark, sf_dir))
_signature = squeeze("regexp_replace(lower(u), '[^\\p{L}\\p{N}_\\s]', ' ', 'g')")
_two = G.PARTS.replace("utterances AS", "raw AS", 1).replace("\np1 AS", f"\nutterances AS (SELECT id * 2 AS id, {squeeze('lower(u)')} AS u FROM raw UNION ALL SELECT id * 2 + 1, {_signature} FROM raw),\np1 AS", 1)
_new = f"""NOT b.background AND b.meaningful AND b.sup IS NOT NULL AND (b.han OR list_has_any(b.a, {G.lst(L.QUERY_WORDS)}) OR b.asks)
  AND (b.h >= 3 OR (len(b.a) >= 2 AND b.n >= 6) OR (len(b.a) = 1 AND list_has_any(b.a, {G.lst(L.CUES)})))"""
_n, _h = "len(regexp_extract_all(a.u, '\\p{L}+'))", f"len(regexp_extract_all(a.u, '[{G.HAN}]'))"
ORACLES["final_turn_candidate"] = f"""WITH {_two} SELECT a.id // 2 AS id, a.u <> '' AND NOT a.noise AND (b.stop OR ({by_name('b.u', TALK)}) IS NOT NULL OR ({_new})
    OR (a.meaningful AND a.sup IS NOT NULL AND (({G.anyof('a.u', A.SUBJECT_TERMS)} AND ({_n} > 0 OR {_h} >= 2)) OR ({G.anyof('a.u', A.REQUEST_TERMS)} AND ({_n} >= 2 OR {_h} >= 3))
      OR {_h} >= 4 OR ({_n} >= 3 AND len(regexp_extract_all(a.u, '\\p{{L}}')) >= 12)))) AS value
  FROM parts a JOIN parts b ON b.id = a.id + 1 WHERE a.id % 2 = 0"""

FAQ = ("How do I pay the fee for a visa in this centre today", "What documents are needed", "one two three four five six seven eight nine ten")
FAQ_ASKED = ("what documents are needed?", "How do I pay the fee for a visa in this centre", "Какие documents are needed what", "ten nine eight seven six five four three two", "what is needed") + ASKED
FAQ_LEAST = 0.9


def faq_candidates(queries, items, subject: str, least: float = FAQ_LEAST):
    """query_id, route, item_id and score: an overview of the subject if that is asked for, else for English queries the
    item whose words are nearly the same. Queries: query_id, text; items: item_id, text."""
    asked = queries.select("query_id", "text", is_overview(F.col("text"), subject).alias("overview"))
    english = asked.filter(~F.col("overview") & (L.detect_language(F.col("text")) == "en"))
    found = matching.best_similar(english, items, least).select("query_id", F.lit("faq").alias("route"), "item_id", F.round("score", 6).alias("score"))
    return asked.filter("overview").select("query_id", F.lit("faq_overview").alias("route"), F.lit(None).cast("bigint").alias("item_id"), F.lit(None).cast("double").alias("score")).union(found)


def _faq(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    bench = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    own = bench.select((-F.col("item_id") - 1001).alias("query_id"), F.upper("text").alias("text"))
    items = bench.union(fixed(spark, FAQ).select((-F.col("n") - 1).alias("item_id"), "x"))
    return faq_candidates(turns.union(own).union(fixed(spark, FAQ_ASKED).select((-F.col("n") - 1).alias("query_id"), "x")), items, "report")


QUERIES["faq_candidate"] = _faq
_az = "regexp_extract_all(lower(text), '[a-z]+')"
_over = f"(list_contains({_az}, 'report') AND NOT list_has_any({_az}, {G.lst(OVERVIEW_SPECIFIC)}) AND list_has_any({_az}, {G.lst(OVERVIEW_WORDS)}))"
_ts = "list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')))"
ORACLES["faq_candidate"] = f"""WITH u AS (SELECT conv_id * 1000 + turn AS query_id, text FROM conversations WHERE role = 'user' UNION ALL SELECT -item_id - 1001, upper(text) FROM benchmark UNION ALL SELECT -n - 1, x FROM {values(FAQ_ASKED)}),
  q AS (SELECT query_id, {_over} AS overview, {G.language('text')} AS lang, {_ts} AS t FROM u),
  f AS (SELECT item_id, {_ts} AS t FROM (SELECT item_id, text FROM benchmark UNION ALL SELECT -n - 1, x FROM {values(FAQ)})),
  c AS (SELECT q.t, item_id, len(list_intersect(q.t, f.t))::DOUBLE / len(list_distinct(list_concat(q.t, f.t))) AS score FROM (SELECT DISTINCT t FROM q WHERE NOT overview AND lang = 'en' AND len(t) > 0) q JOIN f
    ON least(len(q.t), len(f.t)) >= {FAQ_LEAST} * greatest(len(q.t), len(f.t)) - 1e-9),
  b AS (SELECT * FROM c WHERE score >= {FAQ_LEAST} - 1e-9 QUALIFY row_number() OVER (PARTITION BY t ORDER BY score DESC, item_id) = 1)
  SELECT query_id, 'faq_overview' AS route, NULL::BIGINT AS item_id, NULL::DOUBLE AS score FROM q WHERE overview
  UNION ALL SELECT query_id, 'faq', item_id, round(score, 6) FROM q JOIN b USING (t) WHERE NOT overview AND lang = 'en'"""


def _index(spark, sf_dir):
    """Vectors of documents that hold text, written as an index and read again: id, dimension and first component."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").union(fixed(spark, (" ", "")).select(-F.col("n") - 1, "x"))
    vecs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    rows = docs.join(vecs.union(vecs.filter("id < 2").select(-F.col("id") - 1, "vector")), "id")
    place = shared.folder(spark, "vector-index")
    vectors.write_index(rows, place, 64)
    return spark.read.parquet(place).select("id", F.size("vector").cast("bigint").alias("dim"), F.round(F.get("vector", F.lit(0)), 6).alias("first"))


QUERIES["build_vector_index"] = _index
ORACLES["build_vector_index"] = """SELECT vec_id AS id, len(embedding) AS dim, round(embedding[1]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first
  FROM embeddings JOIN documents ON doc_id = vec_id WHERE trim(text) <> ''"""

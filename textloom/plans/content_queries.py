"""Queries of payloads of any shape, page documents, text vectors, speech and written files, with DuckDB SQL where it can
express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import numbers
from textloom.functions import speech as S
from textloom.functions.text import LETTERS
from textloom.operators import paged, text_vectors, vectors
from textloom.operators import payloads as P
from textloom.operators.paged import ENOUGH_WORDS
from textloom.sources import jsonl, shared

from .answer_queries import sanitized_sql
from .inputs import fixed, table, values
from .text_queries import squeeze, trim

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# Payloads: users' and assistants' turns as ten shapes of JSON. `t` and `r` stand for the quoted text and role.
SHAPES = (
    '{"answer": @t, "confidence": "Partial"}',
    '{"result": {"data": {"message": {"content": {"text": {"summary": @t}}}}}, "score": "0.2"}',
    '{"choices": [{"message": {"content": @t}}, {"message": "other"}], "confidence": 0.3}',
    '{"data": {"documents": [{"page_content": {"summary": @t}, "title": @r, "similarity": "x"}, @t, 7, {"body": "", "url": "u"}], "result": {"chunks": [@r]}}, "confidence": "0.3"}',
    '{"contexts": [], "context": {"context": @t, "source": @r, "similarity": 0.4}, "citations": [{"name": {"text": @r}}, "x", "x", "", {"url": "v"}, 5, "w", "z"]}',
    "@t",
    '{"spoken": "", "response": 12.5, "score": "none", "similarity": 0.05}',
    '{"sources": [{"text": {"a": 1}, "documentName": @r, "rerank_score": 0.9}, {"content": @t, "ann_score": 0.7}], "details": []}',
    '{"choices": ["no object"], "message": {"choices": [{"text": " ", "message": {"data": {"spoken": @t}}}]}, "references": @r, "details": null}',
    '[{"answer": @t}]',
)


def _payload_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = lambda x: F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "")
    rows = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), ((F.col("conv_id") + F.col("turn")) % len(SHAPES)).cast("int").alias("k"),
        quoted(F.left("text", F.lit(80))).alias("t"), quoted(F.col("role")).alias("r"),
    )
    shape = F.get(F.array(*[F.lit(x) for x in SHAPES]), F.col("k"))
    return rows.select("id", F.replace(F.replace(shape, F.lit("@t"), F.col("t")), F.lit("@r"), F.col("r")).alias("body"))


def _normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = _payload_bodies(spark, sf_dir).select("id", F.parse_json("body").alias("v"))
    found = P.normalised(bodies)
    chunks = F.array_join(F.transform("chunks", lambda x: F.concat_ws("¦", x["text"], x["source"])), "¶")
    return found.withColumn("chunks", chunks).withColumn("citations", F.array_join("citations", "¦")).withColumn("score", F.round("score", 6))


def _normalised_sql() -> str:
    listed = ", ".join("'" + x.replace("'", "''") + "'" for x in SHAPES)
    filled = lambda x: f"({x} IS NOT NULL AND NOT regexp_matches({x}::VARCHAR, '^(null|false|\"\"|\\[\\]|\\{{\\}}|-?0(\\.0*)?)$'))"
    member = lambda v, k: f"json_extract({v}, '$.{k}')"
    first = lambda v, keys: "coalesce(" + ", ".join(f"CASE WHEN {filled(member(v, k))} THEN {member(v, k)} END" for k in keys) + ")"
    n = len(P.TEXT_KEYS)
    steps = [(p, k, key, "text") for p in ("text", "answer") for k, key in enumerate(P.TEXT_KEYS)]
    steps += [("answer", n + k, key, "answer") for k, key in enumerate(P.NESTED)]
    steps += [("chunks", k, key, "list") for k, key in enumerate(P.CHUNK_KEYS)] + [("chunks", len(P.CHUNK_KEYS) + k, key, "chunks") for k, key in enumerate(P.CHUNK_NESTED)]
    rows = ", ".join(f"('{p}', {k}, '$.{key}', '{q}')" for p, k, key, q in steps) + f", ('answer', {n + len(P.NESTED)}, 'choices', 'answer')"
    chosen = f"CASE WHEN json_type({member('v', 'choices[0]')}) = 'OBJECT' THEN coalesce({first('v', ('choices[0].message',))}, {member('v', 'choices[0]')}) END"
    numbers = "('BIGINT', 'UBIGINT', 'DOUBLE')"

    def descent(name: str, root: str) -> str:
        return f"""{name} AS (SELECT key, place, []::INT[] AS r, v FROM ({root})
    UNION ALL SELECT key, next, list_append(r, rank), w FROM (SELECT key, next, r, rank, CASE WHEN path = 'choices' THEN {chosen} ELSE json_extract(v, path) END AS w
      FROM {name} JOIN steps ON from_place = place WHERE json_type(v) = 'OBJECT') x WHERE w IS NOT NULL),
  {name}_ends AS (SELECT *, CASE WHEN json_type(v) = 'VARCHAR' THEN {trim("(v->>'$')")} WHEN place = 'text' AND json_type(v) IN {numbers} THEN v::VARCHAR END AS t FROM {name})"""

    name = lambda x: f"CASE json_type({x}) WHEN 'VARCHAR' THEN {x}->>'$' ELSE {x}::VARCHAR END"
    listing = "CASE json_type(v) WHEN 'ARRAY' THEN json_extract(v, '$[*]')"
    score = "coalesce(" + ", ".join(f"CASE WHEN {member('v', k)} IS NOT NULL THEN coalesce(try_cast(v->>'$.{k}' AS DOUBLE), -1e9) END" for k in P.CHUNK_SCORES) + ", 0.0)"
    numeric = ", ".join(f"try_cast(v->>'$.{k}' AS DOUBLE)" for k in P.SCORE_KEYS)
    by = lambda s: f"CASE WHEN {s} >= 0.25 THEN 'high' WHEN {s} >= 0.1 THEN 'partial' ELSE 'not_found' END"
    return f"""WITH RECURSIVE s AS (SELECT conv_id * 1000 + turn AS id, ([{listed}])[(conv_id + turn) % {len(SHAPES)} + 1] AS shape, to_json(left(text, 80))::VARCHAR AS t, to_json(role)::VARCHAR AS r FROM conversations),
  p AS (SELECT id, replace(replace(shape, '@t', t), '@r', r)::JSON AS v FROM s),
  steps(from_place, rank, path, next) AS (VALUES {rows}),
  {descent('d', "SELECT {'id': id, 'r': []::INT[], 'n': 0::BIGINT} AS key, 'answer' AS place, v FROM p")},
  {descent('c', "SELECT {'id': id, 'r': []::INT[], 'n': 0::BIGINT} AS key, 'chunks' AS place, v FROM p")},
  answers AS (SELECT key.id AS id, arg_min(t, r) AS answer FROM d_ends WHERE t <> '' GROUP BY key.id),
  lists AS (SELECT key.id AS id, r, {listing} WHEN 'VARCHAR' THEN [v] WHEN 'OBJECT' THEN [v] END AS l FROM c WHERE place = 'list'),
  items AS (SELECT {{'id': id, 'r': r, 'n': generate_subscripts(l, 1) - 1}} AS key, unnest(l) AS v FROM lists),
  {descent('i', f"SELECT key, 'text' AS place, {first('v', P.CHUNK_TEXTS)} AS v FROM items WHERE json_type(v) = 'OBJECT' AND {first('v', P.CHUNK_TEXTS)} IS NOT NULL")},
  said AS (SELECT key, arg_min(t, r) AS t FROM i_ends WHERE t <> '' GROUP BY key),
  raw AS (SELECT items.key, CASE WHEN json_type(v) = 'VARCHAR' THEN {trim("(v->>'$')")} ELSE coalesce(t, '') END AS t, json_type(v) = 'VARCHAR' AS plain, v FROM items LEFT JOIN said USING (key) WHERE json_type(v) IN ('VARCHAR', 'OBJECT')),
  chunks AS (SELECT key.id AS id, key.r AS r, key.n AS n, t, CASE WHEN plain THEN '{P.SERVICE}' ELSE {name(first('v', P.CHUNK_SOURCES))} END AS source,
    CASE WHEN plain THEN '{P.SERVICE}' ELSE {trim(f"coalesce({name(first('v', P.CHUNK_SOURCES))}, {name(first('v', P.CHUNK_CITED))}, '{P.SERVICE}')")} END AS cited,
    CASE WHEN plain THEN 0.0 ELSE {score} END AS score FROM raw WHERE t <> '' OR (NOT plain AND {first('v', ('text', 'content', 'context'))} IS NOT NULL)
    QUALIFY rank() OVER (PARTITION BY key.id ORDER BY key.r) = 1),
  listed AS (SELECT id, string_agg(concat_ws('¦', t, source), '¶' ORDER BY n) AS chunks, max(CASE WHEN score > -1e9 THEN score END) AS best FROM chunks GROUP BY id),
  cites AS (SELECT id, generate_subscripts(l, 1) - 1 AS n, unnest(l) AS v FROM (SELECT id, {listing} ELSE [v] END AS l FROM (SELECT id, {first('v', P.CITATION_KEYS)} AS v FROM p WHERE json_type(v) = 'OBJECT') x WHERE v IS NOT NULL)),
  {descent('q', f"SELECT {{'id': id, 'r': []::INT[], 'n': n}} AS key, 'text' AS place, CASE WHEN json_type(v) = 'OBJECT' THEN {first('v', P.CITATION_NAMES)} ELSE v END AS v FROM cites")},
  named AS (SELECT key.id AS id, key.n AS n, arg_min(t, r) AS name FROM q_ends WHERE t <> '' GROUP BY key.id, key.n),
  own AS (SELECT * FROM (SELECT id, name, min(n) AS n FROM named GROUP BY id, name) QUALIFY row_number() OVER (PARTITION BY id ORDER BY n) <= {P.MOST_CITATIONS}),
  their AS (SELECT * FROM (SELECT id, cited AS name, min(n) AS n FROM chunks WHERE cited <> '' GROUP BY id, cited) QUALIFY row_number() OVER (PARTITION BY id ORDER BY n) <= {P.MOST_CITATIONS}),
  o AS (SELECT id, string_agg(name, '¦' ORDER BY n) AS own FROM own GROUP BY id), h AS (SELECT id, string_agg(name, '¦' ORDER BY n) AS their FROM their GROUP BY id),
  z AS (SELECT p.id, coalesce(answer, '') AS answer, coalesce(chunks, '') AS chunks, coalesce(own, their, '') AS citations, CASE WHEN json_type(v) = 'OBJECT' THEN coalesce({numeric}, best, 0.0) ELSE coalesce(best, 0.0) END AS numeric,
    CASE WHEN json_type({member('v', 'confidence')}) = 'VARCHAR' THEN lower({trim("(v->>'$.confidence')")}) WHEN json_type({member('v', 'confidence')}) IN {numbers} THEN v->>'$.confidence' END AS label,
    json_type(v) = 'OBJECT' AND {member('v', 'details')} IS NOT NULL AS is_contract FROM p LEFT JOIN answers USING (id) LEFT JOIN listed USING (id) LEFT JOIN o USING (id) LEFT JOIN h USING (id))
  SELECT id, answer, chunks, citations, CASE WHEN label IN ('high', 'partial', 'not_found') THEN label WHEN try_cast(label AS DOUBLE) IS NOT NULL THEN {by('try_cast(label AS DOUBLE)')}
      WHEN numeric > 0 THEN {by('numeric')} WHEN answer <> '' THEN 'high' ELSE 'not_found' END AS confidence,
    round(CASE WHEN label IN ('high', 'partial', 'not_found') THEN numeric WHEN try_cast(label AS DOUBLE) IS NOT NULL THEN try_cast(label AS DOUBLE) WHEN numeric > 0 THEN numeric WHEN answer <> '' THEN 0.92 ELSE 0.0 END, 6) AS score,
    is_contract FROM z"""


QUERIES["payload_normalised"] = _normalised
ORACLES["payload_normalised"] = _normalised_sql()
CHUNK_PAYLOADS = (
    '{"chunks": [{"content": "c1", "source": "s1"}, "plain", {"text": ""}, {"text": "t2", "title": "T"}]}', '{"chunks": [], "docs": ["d1", " "]}', '{"context": "whole"}', '{"result": {"documents": [{"body": "deep", "url": "u"}]}}',
    "{}", "null", '{"contexts": {"page_content": "p", "document": "doc"}}',
)


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = _payload_bodies(spark, sf_dir).union(fixed(spark, CHUNK_PAYLOADS).select(-F.col("n") - 1, "x"))
    return P.chunks_of(bodies.select("id", F.parse_json("body").alias("v"))).select("id", F.col("n").cast("bigint").alias("pos"), "text", "source")


QUERIES["payload_chunks"] = _chunks
_shaped = "replace(replace(shape, '@t', t), '@r', r)::JSON AS v FROM s"
_until_chunks = _normalised_sql().replace(_shaped + ")", f"{_shaped} UNION ALL SELECT -n - 1, x::JSON FROM {values(CHUNK_PAYLOADS)})").partition(",\n  listed AS")[0]
ORACLES["payload_chunks"] = f"{_until_chunks} SELECT id, n AS pos, t AS text, source FROM chunks"

# Page documents: the documents, ten lines a page, each page with a marker or number, a header and a footer; the second page
# is a table of contents. Blank lines go when pages are cut.
PAGE_LINES = 10
_PAGE_TEXT = """array_join(transform(filter(sequence(0, cast(ceil(size(l) / 10.0) AS int) - 1), k -> true), k -> concat_ws('\\n',
    CASE WHEN k % 3 = 2 THEN cast(k AS string) ELSE concat('[H2] Page ', k + 1) END, concat('Report of ', source, ' office'),
    CASE WHEN k = 1 THEN 'Table of Contents\\nPART 1: FEES ......... 3' END, CASE WHEN k % 4 = 3 THEN '1.2.\\nRules of the house.' END,
    array_join(slice(l, k * 10 + 1, 10), '\\n'), 'All rights stay with the author')), '\\n')"""


def _paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.array_remove(F.transform(F.split("text", "\n", -1), lambda x: F.btrim(x)), "").alias("l"))
    return rows.filter(F.size("l") > 0).select("doc_id", F.expr(_PAGE_TEXT).alias("text"))


def _page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = paged.page_lines(_paged(spark, sf_dir)).filter("line <> ''")
    return lines.groupBy(F.col("id").alias("doc_id"), "page").agg(F.count("*").alias("n_lines"))


def _clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paged.clean_documents(_paged(spark, sf_dir)).withColumnRenamed("id", "doc_id")


BREAKS_SQL = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]"
QUERIES["pdf_page_split"] = _page_counts
QUERIES["clean_pdf_markdown"] = _clean_pages
ORACLES["pdf_page_split"] = f"""WITH RECURSIVE d AS (SELECT doc_id, source, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents),
  k AS (SELECT doc_id, source, l, unnest(range(0, ceil(len(l) / 10.0)::INT)) AS k FROM d),
  p AS (SELECT doc_id, string_agg(concat_ws(chr(10), CASE WHEN k % 3 = 2 THEN k::VARCHAR ELSE concat('[H2] Page ', k + 1) END, concat('Report of ', source, ' office'),
    CASE WHEN k = 1 THEN concat('Table of Contents', chr(10), 'PART 1: FEES ......... 3') END, CASE WHEN k % 4 = 3 THEN concat('1.2.', chr(10), 'Rules of the house.') END,
    array_to_string(l[k * 10 + 1:k * 10 + 10], chr(10)), 'All rights stay with the author'), chr(10) ORDER BY k) AS t FROM k GROUP BY doc_id),
  s AS (SELECT doc_id, generate_subscripts(x, 1) AS n, {trim('unnest(x)')} AS line FROM (SELECT doc_id, regexp_split_to_array(t, '{BREAKS_SQL}') AS x FROM p)),
  f AS (SELECT *, regexp_matches(line, '(?i)^\\[H2\\]\\s+Page\\s+[0-9]+') AS opens, regexp_matches(line, '^[0-9]{{1,3}}$') AS number FROM s WHERE line <> ''),
  w AS (SELECT *, coalesce(sum(CASE WHEN opens OR number THEN 0 ELSE len(regexp_extract_all(line, '[{LETTERS}]{{3,}}')) END) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words FROM f),
  m AS (SELECT doc_id, n, opens, words, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS j FROM w WHERE opens OR number),
  r AS (SELECT DISTINCT doc_id, 0::BIGINT AS n, 0::BIGINT AS j, 0::HUGEINT AS base, false AS cut FROM m
    UNION ALL SELECT m.doc_id, m.n, m.j, CASE WHEN opens OR words - base > {ENOUGH_WORDS} THEN words ELSE base END, opens OR words - base > {ENOUGH_WORDS} FROM r JOIN m ON m.doc_id = r.doc_id AND m.j = r.j + 1),
  c AS (SELECT w.doc_id, w.n, opens OR number AS mark, count(*) FILTER (WHERE cut) OVER (PARTITION BY w.doc_id ORDER BY w.n) AS part FROM w LEFT JOIN r ON r.doc_id = w.doc_id AND r.n = w.n),
  g AS (SELECT doc_id, part, count(*) AS n_lines FROM c WHERE NOT mark GROUP BY doc_id, part)
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY part))::INT AS page, n_lines FROM g"""

# Text for speech: turns with a number and a language in turn.
_LANGS = "CASE conv_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'ru' WHEN 2 THEN 'kk' ELSE 'zh' END"
_TOLD = "concat(left(text, 400), ', and it is turn ', {turn}, ' of ', {conv}, ', ', role, '. Again. again!  ')"


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _TOLD.format(turn="turn", conv="conv_id")
    return table(spark, sf_dir, "conversations").selectExpr("conv_id * 1000 + turn AS id", f"{_LANGS} AS language", f"{x} AS x")


QUERIES["sentenceize"] = lambda spark, sf_dir: _told(spark, sf_dir).select("id", S.sentenceized(F.col("x"), F.col("language")).alias("value"))
QUERIES["prepare_tts_text"] = lambda spark, sf_dir: S.prepared(_told(spark, sf_dir), "x", "language", "value").select("id", "value", S.spaced_like(F.col("value"), F.col("x")).alias("chunk"))


def _sentences_sql(x: str, lang: str) -> str:
    marks, han = S.CLAUSE_MARKS, S.HAN_CLAUSE_MARKS
    mark = f"CASE WHEN regexp_matches(itm.held, '[{marks}{han}]$') THEN right(itm.held, 1) ELSE '' END"
    part = trim(f"left(itm.held, length(itm.held) - length({mark}))")
    word = f"CASE WHEN acc.held <> '' AND {part} <> '' THEN {trim(f'''concat(acc.held, ' ', {part})''')} WHEN {part} <> '' THEN {part} ELSE acc.held END"
    joined = f"CASE WHEN {lang} = 'zh' THEN concat(acc.held, {part}) ELSE {word} END"
    long = f"CASE WHEN {lang} = 'zh' THEN regexp_matches({mark}, '[{han}]') AND length({joined}) >= {S.LONG_HAN} ELSE regexp_matches({mark}, '[{marks}]') AND (len(regexp_extract_all({joined}, '[A-Za-z{S.CYRILLIC}]+')) >= {S.LONG_WORDS} OR length({joined}) >= {S.LONG_CHARS}) END"
    ended = f"CASE WHEN {lang} = 'zh' THEN concat(regexp_replace({joined}, '[ {han}]+$', ''), '。') ELSE concat(regexp_replace({joined}, '[ {marks}]+$', ''), '.') END"
    on = f"CASE WHEN {mark} = '' THEN {joined} WHEN {lang} = 'zh' THEN concat({joined}, {mark}) ELSE {trim(f'concat(rtrim({joined}), {mark})')} END"
    step = f"{{'o': CASE WHEN {long} THEN list_append(acc.o, {ended}) ELSE acc.o END, 'held': CASE WHEN {long} THEN '' ELSE {on} END}}"
    pieces = f"string_split(regexp_replace({x}, '([{marks}{han}])', '\\1' || chr(1), 'g'), chr(1))"
    folded = f"list_reduce(list_prepend({{'o': []::VARCHAR[], 'held': ''}}, list_transform({pieces}, lambda p: {{'o': []::VARCHAR[], 'held': p}})), lambda acc, itm: {step})"
    shown = f"CASE WHEN {lang} = 'zh' THEN y ELSE concat(upper(left({trim('y')}, 1)), substr({trim('y')}, 2)) END"
    whole = f"list_transform([{folded}], lambda f: list_transform(list_filter(list_append(f.o, {trim('f.held')}), lambda y: {trim('y')} <> ''), lambda y: {shown}))[1]"
    return f"CASE WHEN len({pieces}) > 1 THEN CASE WHEN {lang} = 'zh' THEN {trim(f'''array_to_string({whole}, '')''')} ELSE {trim(f'''array_to_string({whole}, ' ')''')} END ELSE {x} END"


def _speech_sql(last: str) -> str:
    spelt = lambda n: " ".join(f"WHEN '{lang}' THEN {numbers.spelled(lang, n, numbers.DUCKDB)}" for lang in ("en", "ru", "kk", "zh"))
    key = lambda x: f"regexp_replace(lower({squeeze(x)}), '^[.!?。！？]+|[.!?。！？]+$', '', 'g')"
    return f"""WITH t AS (SELECT conv_id * 1000 + turn AS id, {_LANGS} AS lang, conv_id, turn, {_TOLD.format(turn='turn', conv='conv_id')} AS x FROM conversations),
  a AS (SELECT *, {sanitized_sql('x')} AS bare, {sanitized_sql('x', '0-9')} AS kept FROM t),
  n AS (SELECT *, {squeeze("regexp_replace(kept, 'turn [0-9]+ of [0-9]+', concat('turn ', CASE lang " + spelt('turn') + " END, ' of ', CASE lang " + spelt('conv_id') + " END))")} AS said FROM a),
  b AS (SELECT *, {sanitized_sql('said')} AS clean FROM n),
  s AS (SELECT *, {_sentences_sql('bare', 'lang')} AS direct, {_sentences_sql('clean', 'lang')} AS told FROM b),
  r AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(again, '([.!?。！？])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {trim('s')}), lambda s: s <> '') AS l FROM (SELECT *, {sanitized_sql('told')} AS again FROM s)),
  z AS (SELECT *, array_to_string(list_filter(l, lambda itm, i: i = 1 OR {key('itm')} <> {key('l[i - 1]')}), ' ') AS once FROM r)
  {last}"""


ORACLES["sentenceize"] = _speech_sql("SELECT id, direct AS value FROM z")
ORACLES["prepare_tts_text"] = _speech_sql(f"SELECT id, value, CASE WHEN value = '' THEN '' ELSE concat(CASE WHEN regexp_matches(x, '^\\s') THEN ' ' ELSE '' END, value, CASE WHEN regexp_matches(x, '\\s$') THEN ' ' ELSE '' END) END AS chunk FROM (SELECT id, x, {sanitized_sql('once')} AS value FROM z)")

# Search from text to ranks: benchmark passages as queries against all documents, by hashed words, then by rare words.
SEARCHED = 20


def _texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return queries, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, docs = (text_vectors.hashed_vectors(x, "id", "text") for x in _texts(spark, sf_dir))
    return vectors.top_k_blocks(queries, docs, SEARCHED)


QUERIES["text_search"] = lambda spark, sf_dir: _hits(spark, sf_dir).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))
QUERIES["rerank_pairs"] = lambda spark, sf_dir: text_vectors.reranked(_hits(spark, sf_dir), *_texts(spark, sf_dir))
_TOK = "unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))"
_NUM = "('0x' || substr(md5(w), {0}))::BIGINT"
_HASHED = f"""tok AS (SELECT 'q' AS side, item_id AS id, {_TOK} AS w FROM benchmark UNION ALL SELECT 'd', doc_id, {_TOK} FROM documents),
  slots AS (SELECT side, id, {_NUM.format('1, 8')} % {text_vectors.DIM} AS slot, sum(CASE WHEN {_NUM.format('9, 1')} % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS x FROM tok GROUP BY ALL),
  sizes AS (SELECT side, id, sqrt(sum(x * x)) AS l FROM slots GROUP BY side, id HAVING sum(x * x) > 0),
  dots AS (SELECT q.id AS query_id, d.id AS id, sum(q.x * d.x) AS p FROM slots q JOIN slots d ON q.slot = d.slot AND q.side = 'q' AND d.side = 'd' GROUP BY q.id, d.id),
  scored AS (SELECT a.id AS query_id, b.id AS id, round(coalesce(p, 0) / (a.l * b.l), 9) AS score FROM sizes a JOIN sizes b ON a.side = 'q' AND b.side = 'd' LEFT JOIN dots ON dots.query_id = a.id AND dots.id = b.id),
  hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored) x WHERE rank <= {SEARCHED})"""
ORACLES["text_search"] = f"WITH {_HASHED} SELECT query_id, id, round(score, 6) AS score, rank FROM hits"
ORACLES["rerank_pairs"] = f"""WITH {_HASHED},
  tf AS (SELECT id, w, count(*) AS tf FROM tok WHERE side = 'd' GROUP BY id, w), df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
  n AS (SELECT count(*) AS n, avg(len(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+'))) AS mean FROM documents),
  size AS (SELECT id, count(*) AS size FROM tok WHERE side = 'd' GROUP BY id),
  lex AS (SELECT h.query_id, h.id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {text_vectors.K1 + 1} / (tf + {text_vectors.K1} * (1 - {text_vectors.B} + {text_vectors.B} * size / mean))) AS lexical
    FROM hits h JOIN (SELECT DISTINCT id, w FROM tok WHERE side = 'q') q ON q.id = h.query_id JOIN tf ON tf.id = h.id AND tf.w = q.w JOIN df ON df.w = q.w JOIN size ON size.id = h.id, n GROUP BY h.query_id, h.id),
  s AS (SELECT h.query_id, h.id, h.rank, round(coalesce(1 / (1 + exp(-(lexical - 10) / 10)), 0.0), 6) AS score FROM hits h LEFT JOIN lex ON lex.query_id = h.query_id AND lex.id = h.id)
  SELECT query_id, id, score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS r FROM s) x WHERE r <= 5"""

# Structured files: pages as lines of JSON, some of them cut off, no JSON, no objects or blank.
_SNIPPET = "trim(left(regexp_replace(html, '<[^>]*>|[^A-Za-z ]', ' '), 90))"


def _structured(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    node = lambda kind, text: F.struct(F.lit(kind).alias("type"), F.lit("h1").alias("tag"), text.alias("text"))
    title = F.when(F.col("page_id") % 5 == 0, "").otherwise(F.concat(F.lit("Page "), "page_id"))
    pairs = F.array(F.struct(F.lit(" Who? ").alias("question"), F.concat(F.lit("Site "), "page_id").alias("answer")), F.struct(F.lit("Empty?").alias("question"), F.lit(" ").alias("answer")))
    record = F.to_json(F.struct("url", title.alias("title"), F.lit("S").alias("section"), F.array(node("header", title), node("text", F.expr(_SNIPPET))).alias("content"), F.when(F.col("page_id") % 2 == 0, pairs).alias("faq_pairs")))
    k = F.col("page_id")
    line = F.when(k % 7 == 0, F.left(record, F.length(record) - 5)).when(k % 11 == 0, F.concat(F.lit("no json "), k)).when(k % 13 == 0, F.concat(F.lit("["), k, F.lit("]"))).when(k % 17 == 0, "  ").otherwise(record)
    place = shared.folder(spark, "lines")
    table(spark, sf_dir, "pages").select(line.alias("value")).write.text(place)
    return jsonl.page_records(spark, place, "site")


QUERIES["scan_jsonl_records"] = lambda spark, sf_dir: _structured(spark, sf_dir)[0].drop("path")
QUERIES["scan_jsonl_rejected"] = lambda spark, sf_dir: _structured(spark, sf_dir)[1].select(F.left("line", F.lit(12)).alias("start")).groupBy("start").agg(F.count("*").alias("n"))
_SNIPPET_SQL = _SNIPPET.replace("' ')", "' ', 'g')")
ORACLES["scan_jsonl_records"] = f"""SELECT 'site' AS site, 'structured_jsonl' AS source_type, {trim('url')} AS url, title, 'S' AS section, '' AS scraped_at, concat(lines, CASE WHEN page_id % 2 = 0 THEN concat(chr(10), 'Q: Who?', chr(10), 'A: Site ', page_id) ELSE '' END) AS body
  FROM (SELECT page_id, url, title, concat_ws(chr(10), CASE WHEN title <> '' THEN concat('[H1] ', title) END, nullif({_SNIPPET_SQL}, '')) AS lines
    FROM (SELECT *, CASE WHEN page_id % 5 = 0 THEN '' ELSE concat('Page ', page_id) END AS title FROM pages)) x
  WHERE page_id % 7 <> 0 AND page_id % 11 <> 0 AND page_id % 13 <> 0 AND page_id % 17 <> 0"""
ORACLES["scan_jsonl_rejected"] = """SELECT start, count(*) AS n FROM (SELECT left(CASE WHEN page_id % 7 = 0 THEN concat('{"url":', to_json(url)) WHEN page_id % 11 = 0 THEN concat('no json ', page_id) ELSE concat('[', page_id, ']') END, 12) AS start
  FROM pages WHERE page_id % 7 = 0 OR page_id % 11 = 0 OR page_id % 13 = 0) GROUP BY start"""

"""Queries of payload, confidence, tag and log rules, each with the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import payload as P
from textloom.functions import text as T

from .inputs import LINES, fixed, table, values
from .text_queries import trim

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

CONFIDENCES = ("high", " Partial", "low", "not_found", "85", "1.7", "0.4", "", "-3", "abc", "1e2", "0.25", "0.1")
KINDS = ("answer", "CLARIFY ", "fallback", "other", "", "smalltalk")
PAYLOADS = (
    '{"answer": " yes ", "text": "no"}', 'text {"a":1} tail', '{"spoken": "", "content": "c"}', "no json", "{broken", '{"summary": "s", "n": 2}',
    '{"result": {"answer": "deep"}}', "[1,2]", "{}", '{"text": null, "response": "r"}',
)
NUMBERS = ("1,234", "1,5", "1,234.5", "12", "1,234,567", "+3,25", "-1,000", "1.5", "12,34,567")


def over(name: str, rows: tuple[str, ...], make: Callable[[Column], Column], sql: str, base: tuple[str, ...] | None = None) -> None:
    """A column over fixed rows x, and over rows of a table: its name, and expressions for id and x (and for x in DuckDB, where
    that is another)."""

    def run(spark, sf_dir):
        own = fixed(spark, rows).select((-F.col("n") - 1).alias("id"), "x")
        if base:
            own = table(spark, sf_dir, base[0]).select(F.expr(base[1]).alias("id"), F.expr(base[2]).alias("x")).union(own)
        return own.select("id", make(F.col("x")).alias("value"))

    QUERIES[name] = run
    own = f"SELECT -n - 1 AS id, x FROM {values(rows)}"
    ORACLES[name] = f"SELECT id, {sql} AS value FROM ({f'SELECT {base[1]} AS id, {base[-1]} AS x FROM {base[0]} UNION ALL {own}' if base else own})"


_t = f"lower({trim('x')})"
_n = f"try_cast({_t} AS DOUBLE)"
_events, _docs, _turns = ("events", "event_id", "props"), ("documents", "doc_id", "text"), ("conversations", "conv_id * 1000 + turn", "text")
over(
    "coerce_confidence", CONFIDENCES, P.coerce_confidence,
    f"coalesce(CASE {_t} WHEN 'high' THEN 0.92 WHEN 'partial' THEN 0.67 WHEN 'low' THEN 0.31 WHEN 'not_found' THEN 0.31 END::DOUBLE, greatest(0.0, least(1.0, CASE WHEN {_n} > 1 THEN {_n} / 100 ELSE {_n} END)), 0.86::DOUBLE)".replace(
        "greatest(0.0, least(1.0, CASE", f"CASE WHEN {_n} IS NOT NULL THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE").replace("END)), 0.86", "END)) END, 0.86"),
    ("events", "event_id", "CAST(value AS STRING)"),
)
ORACLES["coerce_confidence"] = ORACLES["coerce_confidence"].replace("CAST(value AS STRING)", "CAST(value AS VARCHAR)")
_by = lambda s: f"CASE WHEN {s} >= 0.25 THEN 'high' WHEN {s} >= 0.1 THEN 'partial' ELSE 'not_found' END"
over(
    "confidence_ladder", CONFIDENCES, lambda x: P.confidence_ladder(x, F.when(F.col("id") % 2 == 0, F.lit(0.2)), 0.25, 0.10, F.col("id") % 3 == 0),
    f"CASE WHEN {_t} IN ('high', 'partial', 'not_found') THEN {_t} WHEN {_n} IS NOT NULL THEN {_by(_n)} WHEN id % 2 = 0 THEN {_by('0.2')} WHEN id % 3 = 0 THEN 'high' ELSE 'not_found' END",
    ("conversations", "conv_id * 1000 + turn", "role"),
)
over("enum_guard", KINDS, P.enum_guard, f"CASE WHEN {_t} IN {P.ANSWER_KINDS} THEN {_t} ELSE 'answer' END", ("events", "event_id", "event_type"))
over("json_extract_wrapped", PAYLOADS, P.wrapped_json, "regexp_extract(x, '(?s)(\\{.*\\})', 1)", _events)
over("json_extract_strict", PAYLOADS, lambda x: F.when(T.trimmed(x).startswith("{"), P.wrapped_json(x)).otherwise(""),
     f"CASE WHEN starts_with({trim('x')}, '{{') THEN regexp_extract(x, '(?s)(\\{{.*\\}})', 1) ELSE '' END", _events)
_first = lambda js, keys: "coalesce(" + ", ".join(f"nullif({trim(f'''json_extract_string({js}, '$.{k}')''')}, '')" for k in keys) + ")"
_js = "CASE WHEN json_valid(x) THEN x END"
over("json_coalesce_field", PAYLOADS, P.first_text, _first(_js, P.TEXT_KEYS), _events)
over("payload_answer_text", PAYLOADS, lambda x: F.coalesce(P.first_text(x), P.first_text(F.get_json_object(x, "$.result"))),
     f"coalesce({_first(_js, P.TEXT_KEYS)}, {_first(f'''json_extract({_js}, '$.result')''', P.TEXT_KEYS)})", _events)
over("payload_error_rows", PAYLOADS, lambda x: F.expr("CASE WHEN try_parse_json(x) IS NULL THEN 'text' ELSE 'json' END"), "CASE WHEN json_valid(x) THEN 'json' ELSE 'text' END", _events)
over("scan_jsonl_permissive", PAYLOADS, lambda x: F.get_json_object(x, "$.k"), f"json_extract_string({_js}, '$.k')", _events)
over("json_has_key", PAYLOADS, lambda x: F.get_json_object(x, "$.answer").isNotNull() | F.coalesce(x.rlike(r'"answer"\s*:\s*null'), F.lit(False)),
     f"coalesce(json_exists({_js}, '$.answer'), false)", _events)
_tag = lambda n: trim(f"regexp_extract(x, '(?is)\\[\\[{n}\\]\\](.*?)\\[\\[/{n}\\]\\]', 1)")
over("tagged_blocks", LINES, lambda x: F.concat_ws("|", P.tag(x, "spoken"), P.tag(x, "details")), f"concat_ws('|', {_tag('spoken')}, {_tag('details')})", _docs)
_first_line, _rest = trim("split_part(x, chr(10), 1)"), trim("regexp_replace(x, '^[^\\n]*\\n?', '')")
over("wrap_tags", LINES + ("one\ntwo\nthree", "\nx"), lambda x: P.wrap_tags(F.substring_index(x, "\n", 1), F.regexp_replace(x, r"^[^\n]*\n?", "")),
     f"""concat('[[spoken]]', {_first_line}, '[[/spoken]][[details]]', CASE WHEN {_rest} <> '' THEN {_rest} ELSE {_first_line} END, '[[/details]]')""", _turns)
over("normalize_number_token", NUMBERS, P.normalize_number,
     "CASE WHEN regexp_matches(x, '^[+-]?\\d{1,3}(,\\d{3})+(\\.\\d+)?$') THEN replace(x, ',', '') ELSE replace(x, ',', '.') END",
     ("documents", "doc_id", *(f"CASE doc_id % 3 WHEN 0 THEN {n} WHEN 1 THEN concat(n_chars, ',', doc_id % 10) ELSE concat('-', {n}, '.', doc_id % 100) END" for n in ("format_number(n_chars, 0)", "format('{:,}', n_chars)"))))
over("trim_spoken", LINES, lambda x: P.word_cap(x, 28), f"array_to_string(regexp_split_to_array({trim('x')}, '\\s+')[1:28], ' ')", _docs)
over("key_points", LINES, lambda x: F.array_join(F.transform(F.slice(T.sentences(x), 1, 4), lambda s: F.left(s, F.lit(180))), "¦"),
     f"array_to_string(list_transform(list_filter(list_transform(string_split(regexp_replace(x, '([.!?。！？])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {trim('s')}), lambda s: s <> '')[1:4], lambda s: left(s, 180)), '¦')", _docs)
over("content_signature", LINES, lambda x: F.sha2(F.concat_ws("|", F.lit("text"), x), 256), "sha256(concat_ws('|', 'text', x))", _docs)
over("plan_route", LINES, lambda x: F.when(F.lower(T.trimmed(x)).isin("hi", "hello", "thanks", "bye"), "chitchat").when(F.length(T.trimmed(x)) < 3, "direct").otherwise("rag"),
     f"CASE WHEN {_t} IN ('hi', 'hello', 'thanks', 'bye') THEN 'chitchat' WHEN length({trim('x')}) < 3 THEN 'direct' ELSE 'rag' END", _turns)
over("filter_token_confidence", CONFIDENCES, lambda x: F.coalesce(T.trimmed(x).try_cast("double") >= 0.3, F.lit(True)), f"coalesce(try_cast({trim('x')} AS DOUBLE) >= 0.3, true)",
     ("events", "event_id", "concat('0.', get_json_object(props, '$.k'), CASE WHEN event_id % 9 = 0 THEN '?' ELSE '' END)", "concat('0.', json_extract_string(props, '$.k'), CASE WHEN event_id % 9 = 0 THEN '?' ELSE '' END)"))
over("config_coercion", CONFIDENCES, lambda x: F.coalesce(T.trimmed(x).try_cast("int"), F.lit(7)).cast("bigint"), f"CASE WHEN regexp_matches({trim('x')}, '^[+-]?\\d+$') THEN {trim('x')}::BIGINT ELSE 7 END",
     ("events", "event_id", *(f"concat(CASE WHEN event_id % 4 = 0 THEN ' ' ELSE '' END, {k}(props, '$.k'), CASE WHEN event_id % 5 = 0 THEN event_type ELSE '' END)" for k in ("get_json_object", "json_extract_string"))))
over("chunk_text_coalesce", PAYLOADS, lambda x: P.first_text(x, ("text", "content", "context")), _first(_js, ("text", "content", "context")), _events)
over("hard_split_fixed", LINES, lambda x: F.array_join(F.regexp_extract_all(x, F.lit("(?s).{1,1600}"), F.lit(0)), "¦"),
     "array_to_string(list_transform(range(0, ceil(length(x) / 1600)::BIGINT), lambda i: substr(x, i * 1600 + 1, 1600)), '¦')", _docs)
over("pcm_segment_sizes", ("0", "999", "10240", "30720"), lambda x: F.ceil(F.greatest(x.cast("bigint") - 10240, F.lit(0)) / 28800).cast("bigint") + 1,
     "ceil(greatest(x::BIGINT - 10240, 0) / 28800)::BIGINT + 1", ("documents", "doc_id", "CAST(n_chars AS STRING)"))
ORACLES["pcm_segment_sizes"] = ORACLES["pcm_segment_sizes"].replace("CAST(n_chars AS STRING)", "CAST(n_chars AS VARCHAR)")


def _log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    line = P.log_line(F.col("event_type"), {"session_id": F.col("user_id"), "request_id": F.col("event_id"), "latency_ms": F.col("value").cast("bigint")})
    f = e.select("event_id", line.alias("line")).withColumn("f", P.log_fields(F.col("line")))
    return f.select("event_id", "line", F.col("f")["session_id"].alias("session"), F.col("f")["latency_ms"].try_cast("bigint").alias("latency"))


QUERIES["log_kv_roundtrip"] = _log
ORACLES["log_kv_roundtrip"] = """SELECT event_id, concat_ws(' ', concat('event=', event_type), concat('session_id=', user_id), concat('request_id=', event_id),
  CASE WHEN value IS NOT NULL THEN concat('latency_ms=', trunc(value)::BIGINT) END) AS line, user_id::VARCHAR AS session, trunc(value)::BIGINT AS latency FROM events"""
QUERIES["log_route_by_prefix"] = lambda spark, sf_dir: table(spark, sf_dir, "events").select(
    F.explode(F.array_compact(F.array(F.concat(F.lit("log_"), F.left("event_type", F.lit(4))), F.when(F.col("event_type") == "error", "errors")))).alias("file")
).groupBy("file").agg(F.count("*").alias("n"))
ORACLES["log_route_by_prefix"] = """SELECT file, count(*) AS n FROM (SELECT 'log_' || left(event_type, 4) AS file FROM events UNION ALL SELECT 'errors' FROM events WHERE event_type = 'error') GROUP BY file"""
QUERIES["memory_text"] = lambda spark, sf_dir: table(spark, sf_dir, "conversations").filter("role = 'user'").groupBy("conv_id").agg(
    F.max_by("text", "turn").alias("last_question"), F.count("*").alias("n")
).select("conv_id", F.concat(F.lit("questions: "), F.col("n"), F.lit("; last: "), F.left("last_question", F.lit(500))).alias("memory"))
ORACLES["memory_text"] = """SELECT conv_id, concat('questions: ', count(*), '; last: ', left(arg_max(text, turn), 500)) AS memory FROM conversations WHERE role = 'user' GROUP BY conv_id"""
QUERIES["format_context"] = lambda spark, sf_dir: table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t")).select(
    "conv_id", F.array_join(F.transform("t", lambda x: F.concat(F.lit("["), x["turn"].cast("string"), F.lit("] "), x["role"], F.lit(": "), x["text"])), "\n").alias("context")
)
ORACLES["format_context"] = """SELECT conv_id, string_agg(concat('[', turn, '] ', role, ': ', text), chr(10) ORDER BY turn) AS context FROM conversations GROUP BY conv_id"""
QUERIES["budget_prefix"] = lambda spark, sf_dir: table(spark, sf_dir, "conversations").withColumn(
    "s", F.sum(F.length("text")).over(W.partitionBy("conv_id").orderBy("turn"))
).groupBy("conv_id").agg(F.count_if(F.col("s") <= 400).alias("n_turns"))
ORACLES["budget_prefix"] = """SELECT conv_id, count(CASE WHEN s <= 400 THEN 1 END) AS n_turns FROM (SELECT conv_id, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS s FROM conversations) GROUP BY conv_id"""


def accepted_after(gap: float) -> Callable[[Column], Column]:
    """How many of the times (sorted) lie `gap` or more after the last accepted one: a fold, as a refused one moves no
    clock."""
    start = lambda: F.struct(F.lit(None).cast("double").alias("last"), F.lit(0).cast("bigint").alias("n"))
    step = lambda a, t: F.when(a["last"].isNull() | (t - a["last"] >= gap), F.struct(t.alias("last"), (a["n"] + 1).alias("n"))).otherwise(a)
    return lambda times: F.aggregate(times, start(), step)["n"]


GAP = 1.5
TIMES = (0.0, 1.0, 1.5, 1.6, 2.9, 3.1, 4.5, 10.0, 10.0, 11.4, 11.6)


def _suppress(spark, sf_dir):
    """Accepted events by user and type. One that comes GAP or more after the one before it is always accepted, so the
    fold runs over each such run by itself, and a busy user is many small groups."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    e = e.union(spark.createDataFrame([(-1, "own", t) for t in TIMES], "user_id bigint, event_type string, t double"))
    own = W.partitionBy("user_id", "event_type").orderBy("t")
    e = e.withColumn("new", F.coalesce(F.col("t") - F.lag("t").over(own) >= GAP, F.lit(True)).cast("bigint"))
    runs = e.withColumn("run", F.sum("new").over(own.rowsBetween(W.unboundedPreceding, W.currentRow))).groupBy("user_id", "event_type", "run").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return runs.groupBy("user_id", "event_type").agg(F.sum(accepted_after(GAP)(F.col("t"))).alias("accepted"))


QUERIES["dup_suppress_1500ms"] = _suppress
ORACLES["dup_suppress_1500ms"] = f"""WITH RECURSIVE e AS (SELECT user_id, event_type, epoch_us(ts) / 1e6 AS t FROM events UNION ALL SELECT -1, 'own', unnest({list(TIMES)}::DOUBLE[])),
  a AS (SELECT user_id, event_type, min(t) AS t FROM e GROUP BY ALL UNION ALL
    SELECT user_id, event_type, t FROM (SELECT a.user_id, a.event_type, min(e.t) AS t FROM a JOIN e ON e.user_id = a.user_id AND e.event_type = a.event_type AND e.t - a.t >= {GAP} GROUP BY a.user_id, a.event_type, a.t))
  SELECT user_id, event_type, count(*) AS accepted FROM a GROUP BY ALL"""

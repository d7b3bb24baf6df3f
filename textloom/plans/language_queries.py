"""Queries of the language and utterance rules, each with the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import language as G
from textloom.functions import text as T

from .inputs import fixed, quoted, table, values
from .text_queries import squeeze, trim

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

UTTERANCES = (
    "", "  ", "please stop now", "stopwatch", "STOP", "Остановись", "тоқта", "停", "[background noise]", "(music)", "(room noise sounds).", "[hello]",
    "um", "Hmm", "a", "ok", "嗯", "你好", "информация", "привет", "hello", "құжат", "Сәлем, қалай?", "café", "مرحبا", "日本語です", "what is the visa fee",
    "what is the sick leave policy", "internal memo on vacation", "need payroll info", "noise background talk", "фоновый шум здесь", "help", "help me", "repeat",
    "请问 如何 申请 签证", "重复", "what?", "tell me how", "companies near the centre", "the", "is it on", "running processes and stations closed", "yes yes yes yes",
    "this is a long statement", "hmm this is long enough", "42", "?", "зарплата сотрудника", "ішкі саясат", "conversation about fees", "ага",
)
CODES = ("EN", " eng ", "ru-RU", "kaz", "zh-Hant", "xx", "", "cmn")

lst = lambda items: "[" + ", ".join(quoted(x) for x in items) + "]"
HAN, LETTER, NOTW = "一-鿿", G.LETTER, "[^\\p{L}\\p{N}_]+"
SCRIPTS = "[\\x{0600}-\\x{06FF}\\x{0590}-\\x{05FF}\\x{0900}-\\x{0D7F}\\x{0E00}-\\x{0E7F}\\x{3040}-\\x{30FF}\\x{AC00}-\\x{D7AF}]"
words = lambda x: f"regexp_extract_all(lower({x}), '[{LETTER}]+|[{HAN}]')"
bare = lambda x: f"list_filter(regexp_split_to_array(lower({trim(x)}), '{NOTW}'), lambda w: w <> '')"
anyof = lambda x, items: f"len(list_filter({lst(items)}, lambda i: contains({x}, i))) > 0"
W = G.WRAPPED.replace("\\(", "(").replace("\\)", ")")


def language(x: str) -> str:
    return f"""CASE WHEN regexp_matches({x}, '[{HAN}]') THEN 'zh' WHEN {anyof(f'lower({x})', G.KAZAKH_HINTS)} THEN 'kk'
      WHEN regexp_matches({x}, '[{G.KAZAKH_LETTERS}]') THEN 'kk' WHEN regexp_matches({x}, '[А-Яа-яЁё]') THEN 'ru' ELSE 'en' END"""


def supported(x: str) -> str:
    return f"CASE WHEN {trim(x)} <> '' AND NOT regexp_matches({x}, '{SCRIPTS}') AND NOT regexp_matches({x}, '{G.LATIN_EXTENDED}') THEN {language(trim(x))} END"


#: Parts of an utterance u that the rules use, computed step by step.
PARTS = f"""
utterances AS (SELECT conv_id * 1000 + turn AS id, text AS u FROM conversations UNION ALL SELECT -n - 1, x FROM {values(UTTERANCES)}),
p1 AS (SELECT id, u, {trim('u')} AS t, lower(u) AS low, {words('u')} AS w, {bare('u')} AS bw,
  CASE WHEN regexp_matches(lower({trim('u')}), '{G.WRAPPED}') THEN regexp_extract(lower({trim('u')}), '{G.WRAPPED}', 1) ELSE lower({trim('u')}) END AS inn FROM utterances),
p2 AS (SELECT *, array_to_string({bare('inn')}, ' ') AS ph, {bare('inn')} AS pw, list_filter(w, lambda x: NOT regexp_matches(x, '[{HAN}]')) AS a FROM p1),
p3 AS (SELECT *, len(w) - len(a) AS h, length(array_to_string(a, '')) AS n,
  t <> '' AND (lower(t) IN {tuple(G.NOISE_PHRASES)} OR ph IN {tuple(G.NOISE_PHRASES)} OR (len(pw) > 0 AND len(list_filter(pw, lambda x: list_contains({lst(G.NOISE_WORDS)}, x))) = len(pw))) AS noise,
  CASE WHEN len(bw) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(bw, lambda x: list_contains({lst(G.NOISE_WORDS)}, x) OR list_contains({lst(G.NOISE_PHRASES)}, x)
    OR contains(x, 'noise') OR contains(x, 'background') OR contains(x, 'фон'))) / len(bw) END AS ratio,
  {squeeze('low')} IN {tuple(G.STOP_PHRASES)} OR list_has_any(w, {lst(G.STOP_WORDS)}) AS stop,
  {anyof('low', G.HAN_QUERY_TERMS)} AS han FROM p2),
p4 AS (SELECT *, t <> '' AND (list_has_any(w, {lst(G.QUERY_WORDS)}) OR (len(a) = 1 AND list_has_any(a, {lst(G.CUES)})) OR han) AS signal,
  t <> '' AND NOT (ph IN {tuple(G.NOISE_PHRASES)} OR (regexp_matches(t, '{G.WRAPPED}') AND len(pw) > 0 AND len(list_filter(pw, lambda x: list_contains({lst(G.NOISE_WORDS)}, x))) = len(pw)))
    AND array_to_string(bw, ' ') NOT IN {tuple(G.FILLERS)} AND (len(regexp_extract_all(t, '[{LETTER}{HAN}]')) >= 2 OR regexp_matches(t, '[{HAN}]')) AS meaningful,
  {supported('u')} AS sup FROM p3),
parts AS (SELECT *, noise OR (NOT signal AND ratio >= {G.MAX_RATIO}) AS background, regexp_matches(u, '[?？]') AS asks FROM p4)
"""


def utterances(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("u"))
    return turns.union(fixed(spark, UTTERANCES).select(-F.col("n") - 1, "x"))


def add(name: str, make: Callable[[], Column], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: utterances(spark, sf_dir).select("id", make().alias("value"))
    ORACLES[name] = f"WITH {PARTS} SELECT id, {sql} AS value FROM parts"


add("detect_language", lambda: G.detect_language(F.col("u")), language("u"))
add("detect_supported_language", lambda: G.supported_language(F.col("u")), "sup")
add("answer_language", lambda: F.coalesce(G.alias(G.supported_language(F.col("u"))), F.lit("en")), "coalesce(sup, 'en')")
add("stop_command", lambda: G.is_stop_command(F.col("u")), "stop")
add("noise_utterance", lambda: G.is_noise_utterance(F.col("u")), "noise")
add("non_speech_ratio", lambda: G.non_speech_ratio(F.col("u")), "ratio")
add("meaningful_speech", lambda: G.is_meaningful(F.col("u")), "meaningful")
add("valid_live_text", lambda: G.is_meaningful(F.col("u")) & ~G.is_noise_utterance(F.col("u")), "meaningful AND NOT noise")
add("query_signal", lambda: G.has_query_signal(F.col("u")), "signal")
add(
    "new_query_candidate", lambda: G.is_new_query(F.col("u")),
    f"""stop OR (NOT background AND meaningful AND sup IS NOT NULL AND (han OR list_has_any(a, {lst(G.QUERY_WORDS)}) OR asks)
      AND (h >= 3 OR (len(a) >= 2 AND n >= 6) OR (len(a) = 1 AND list_has_any(a, {lst(G.CUES)}))))""",
)
_log = lambda: F.when(F.col("id") % 7 == 0, F.lit(-2.5)).when(F.col("id") % 7 != 1, F.lit(-0.5))
add(
    "interrupt_candidate", lambda: G.is_interrupt(F.col("u"), _log()),
    f"""u <> '' AND id % 7 <> 0 AND NOT noise AND (stop OR (sup IS NOT NULL AND meaningful AND NOT background AND (signal OR asks
      OR CASE WHEN len(w) = 0 THEN false WHEN len(a) < 2 THEN len(a) = 1 AND list_has_any(a, {lst(G.CUES)})
         ELSE (n >= 10 AND NOT list_has_any(a, {lst(G.FILLERS[1:])})) OR han END)))""",
)
_norm = squeeze("regexp_replace(low, '[^\\p{L}\\p{N}_\\s]', ' ', 'g')")
_stems = tuple(x for x in G.INTERNAL_STEMS if len(x) >= 5)
_internal = f"""({_norm} <> '' AND ({anyof(_norm, G.INTERNAL_PHRASES + _stems)} OR list_has_any(regexp_extract_all(low, '[{LETTER}0-9]+'), {lst(G.INTERNAL_STEMS)})))"""
add("route_internal_query", lambda: F.when(G.is_internal_query(F.col("u")), "internal").otherwise("public"), f"CASE WHEN {_internal} THEN 'internal' ELSE 'public' END")


def forms(x: str) -> str:
    cut = lambda k: f"left({x}, length({x}) - {k})"
    items = [x, f"CASE {x} WHEN 'center' THEN 'centre' WHEN 'centre' THEN 'center' END", f"CASE WHEN ends_with({x}, 'ies') AND length({x}) > 5 THEN {cut(3)} || 'y' END"]
    items += [f"CASE WHEN ends_with({x}, '{s}') AND length({x}) > {len(s) + 3} THEN {cut(len(s))} END" for s in G.SUFFIXES]
    items.append(f"CASE WHEN ends_with({x}, 'e') AND length({x}) > 4 THEN {cut(1)} END")
    return "[" + ", ".join(items) + "]"


def stems(x: str) -> str:
    found = f"list_filter(regexp_extract_all(lower({x}), '[{LETTER}0-9]+'), lambda w: length(w) > 2)"
    return f"list_sort(list_distinct(list_filter(flatten(list_transform({found}, lambda w: {forms('w')})), lambda f: f IS NOT NULL AND length(f) > 2)))"


_left = f"list_filter({stems('u')}, lambda s: NOT list_contains({lst(G.STOP_TOKENS)}, s))"
_important = f"CASE WHEN len({_left}) > 0 THEN {_left} ELSE {stems('u')} END"
add("token_forms", lambda: F.array_join(G.stemmed_tokens(F.col("u")), " "), f"array_to_string({stems('u')}, ' ')")
add("important_tokens", lambda: F.array_join(G.important_tokens(F.col("u")), " "), f"array_to_string({_important}, ' ')")
_plain = rf"([\p{{L}}\p{{N}}_&&[^{G.HAN}]]+|[{G.HAN}])"
add(
    "tokens_plain", lambda: F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.col("u")), F.lit(_plain), F.lit(1)))), " "),
    f"array_to_string(list_sort(list_distinct(regexp_extract_all(regexp_replace(low, '([{HAN}])', ' \\1 ', 'g'), '[\\p{{L}}\\p{{N}}_]+'))), ' ')",
)


def _pairs(spark, sf_dir):
    """Each turn with the next one of its conversation."""
    t = table(spark, sf_dir, "conversations")
    after = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return t.join(after, ["conv_id", "turn"])


PAIRS_SQL = "(SELECT a.conv_id, a.turn, a.text, b.text AS answer FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"
_imp = _important.replace("lower(u)", "lower(text)")
_n = f"len({_imp})"
_cov = f"CASE WHEN {_n} > 0 THEN len(list_intersect({_imp}, {stems('answer')})) / {_n} ELSE 1.0::DOUBLE END"
QUERIES["query_coverage"] = lambda spark, sf_dir: _pairs(spark, sf_dir).select("conv_id", "turn", F.round(G.coverage(F.col("text"), F.col("answer")), 6).alias("coverage"))
ORACLES["query_coverage"] = f"SELECT conv_id, turn, round({_cov}, 6) AS coverage FROM {PAIRS_SQL}"


def _confidence(spark, sf_dir):
    rows = _pairs(spark, sf_dir).select("conv_id", "turn", G.coverage(F.col("text"), F.col("answer")).alias("c"), F.size(G.important_tokens(F.col("text"))).alias("n"))
    label = F.element_at(G.array(("high", "partial", "not_found")), (F.col("conv_id") % 3 + 1).cast("int"))
    return rows.select("conv_id", "turn", G.adjusted_confidence(label, F.col("c"), F.col("n")).alias("label"))


QUERIES["coverage_confidence"] = _confidence
ORACLES["coverage_confidence"] = f"""WITH c AS (SELECT conv_id, turn, {_cov} AS c, {_n} AS n, ['high', 'partial', 'not_found'][conv_id % 3 + 1] AS l FROM {PAIRS_SQL})
  SELECT conv_id, turn, CASE WHEN l = 'not_found' OR n <= 0 OR c >= CASE WHEN n >= 2 THEN 0.67 ELSE 1 END THEN l
    WHEN c >= CASE WHEN n >= 2 THEN 0.4 ELSE 1 END THEN CASE l WHEN 'high' THEN 'partial' ELSE l END ELSE 'not_found' END AS label FROM c"""
QUERIES["jaccard_tokens"] = lambda spark, sf_dir: _pairs(spark, sf_dir).select(
    "conv_id", "turn", F.round(T.jaccard(T.token_set(F.col("text")), T.token_set(F.col("answer"))), 6).alias("score")
)
_ts = lambda x: f"list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+'))"
ORACLES["jaccard_tokens"] = f"""WITH s AS (SELECT conv_id, turn, {_ts('text')} AS a, {_ts('answer')} AS b FROM {PAIRS_SQL})
  SELECT conv_id, turn, round(CASE WHEN len(a) + len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END, 6) AS score FROM s"""
QUERIES["distinct_tokens"] = lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", F.size(T.token_set(F.col("text"))).cast("bigint").alias("n"))
ORACLES["distinct_tokens"] = f"SELECT doc_id, len({_ts('text')}) AS n FROM documents"
QUERIES["lang_alias"] = lambda spark, sf_dir: fixed(spark, CODES).union(table(spark, sf_dir, "documents").select("doc_id", "lang")).select(
    F.col("n").alias("id"), F.coalesce(G.alias(F.col("x")), F.lit("en")).alias("lang")
)
ORACLES["lang_alias"] = f"""SELECT id, CASE {' '.join(f"WHEN lower({trim('x')}) = '{k}' THEN '{v}'" for k, v in G.ALIASES.items())} ELSE 'en' END AS lang
  FROM (SELECT n AS id, x FROM {values(CODES)} UNION ALL SELECT doc_id, lang FROM documents)"""

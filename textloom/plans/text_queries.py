"""Queries of the text scalars and line predicates, each with the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import text as T

from .inputs import CHUNKS, FILES, LINES_SQL, URLS, fixed, lines, table, values

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# The rules once more, as DuckDB SQL over an expression.
trim = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
squeeze = lambda x: trim(f"regexp_replace({x}, '\\s+', ' ', 'g')")
words = lambda x: f"len(regexp_extract_all({x}, '[{T.LETTERS}]{{3,}}'))"
estimate = lambda x: f"greatest(1, length({x}) // 4)"
key = lambda x: f"lower(regexp_replace(regexp_replace({trim(x)}, '^\\s*[-*]\\s+', ''), '\\s+', ' ', 'g'))"
has = lambda x, p: f"regexp_matches({x}, '{p}')"
count = lambda x, part: f"((length({x}) - length(replace({x}, '{part}', ''))) / {len(part)})"
inside = lambda items: "(" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + ")"


def noise(x: str) -> str:
    s = trim(x)
    return f"""({s} = '' OR {key(x)} IN {inside(T.NAV_LINES)} OR {has(s, '(?i)^(?:' + '|'.join(T.NAV_OPENINGS) + ')')}
      OR ({has(s, '\\.{4,}')} AND {words(s)} < 12) OR {has(s, '^[-_=]{5,}$')} OR {has(s, '^\\d{1,4}$')}
      OR {has(s, '(?i)^\\[\\s*image:.*\\]$')} OR starts_with({s}, '[IMAGE:') OR (starts_with({s}, '<') AND {has(s, '(?i)\\b(form|input|div|script|style)\\b')})
      OR starts_with({s}, 'ATTACHMENTS:') OR starts_with({s}, 'DOWNLOADED_FILES:') OR {count(s, '(data)')} >= 2
      OR {count(f'lower({s})', 'download')} >= 3 OR ({count(s, '(data)')} >= 1 AND {words(s)} <= 6))"""


def low(x: str) -> str:
    s = trim(x)
    opening = " OR ".join(f"starts_with({s}, '{o}')" for o in T.LOW_OPENINGS)
    return f"""({s} = '' OR lower(regexp_replace({s}, '\\s+', ' ', 'g')) IN {inside(T.LOW_LINES)} OR {opening}
      OR (starts_with({s}, '<') AND {has(s, '(?i)\\b(form|script|style|input|div|a)\\b')}) OR {has(s, '^[-_=]{5,}$')}
      OR ({has(s, '\\.{4,}')} AND {words(s)} < 12) OR {count(s, '(data)')} >= 2 OR ({count(s, '(data)')} >= 1 AND {words(s)} <= 6)
      OR {count(f'lower({s})', 'download')} >= 3 OR contains({s}, '/http:/') OR contains({s}, '/https:/'))"""


def orphan(x: str) -> str:
    s = trim(x)
    return f"""({s} <> '' AND NOT {has(s, '^(\\[H|-|\\|)')} AND ({key(x)} IN {inside(T.LINK_WORDS)}
      OR ({words(s)} <= 1 AND length({s}) <= 8 AND NOT {has(s, '[0-9]')})))"""


def contents(x: str) -> str:
    s = trim(x)
    return f"({has(s, '\\.{4,}\\s*\\d+\\s*$')} OR {has(s, '(?i)^(PART|Schedule|Chapter)\\s+\\d+.+\\s+\\d{1,3}$')})"


def halves(x: str) -> tuple[str, str, str]:
    w = f"string_split({squeeze(x)}, ' ')"
    half = f"(len({w}) // 2)"
    return w, f"array_to_string(list_slice({w}, 1, {half}), ' ')", f"array_to_string(list_slice({w}, {half} + 1, len({w})), ' ')"


def collapse(x: str) -> str:
    w, left, right = halves(x)
    return f"CASE WHEN len({w}) >= 2 AND len({w}) % 2 = 0 AND {key(left)} = {key(right)} THEN {left} ELSE {squeeze(x)} END"


def line_query(name: str, make: Callable[[], Column | dict[str, Column]], sql: str | dict[str, str], where: bool = False) -> None:
    """A query over all lines that adds columns, or (where) keeps the lines for which the one column holds."""
    exprs = sql if isinstance(sql, dict) else {"hit" if where else "value": sql}

    def run(spark, sf_dir):
        rows, made = lines(spark, sf_dir), make()
        columns = made if isinstance(made, dict) else {"hit" if where else "value": made}
        if where:
            return rows.filter(columns["hit"])
        return rows.select("doc_id", "pos", *[c.alias(k) for k, c in columns.items()])

    QUERIES[name] = run
    if where:
        ORACLES[name] = f"WITH {LINES_SQL} SELECT doc_id, pos, line FROM lines WHERE {exprs['hit']}"
    else:
        ORACLES[name] = f"WITH {LINES_SQL} SELECT doc_id, pos, " + ", ".join(f"{v} AS {k}" for k, v in exprs.items()) + " FROM lines"


def fixed_query(name: str, rows: tuple[str, ...], base, make: Callable[[], dict[str, Column]], sql: dict[str, str]) -> None:
    """A query over a column x of a table (base: table, id, text column; or None) and fixed rows."""

    def run(spark, sf_dir):
        own = fixed(spark, rows).select((-F.col("n") - 1).alias("id"), "x")
        if base:
            own = table(spark, sf_dir, base[0]).select(F.col(base[1]).alias("id"), F.col(base[2]).alias("x")).union(own)
        return own.select("id", *[c.alias(k) for k, c in make().items()])

    QUERIES[name] = run
    own = f"SELECT -n - 1 AS id, x FROM {values(rows)}"
    source = f"SELECT {base[1]} AS id, {base[2]} AS x FROM {base[0]} UNION ALL {own}" if base else own
    ORACLES[name] = "SELECT id, " + ", ".join(f"{v} AS {k}" for k, v in sql.items()) + f" FROM ({source})"


line_query("filter_noise_lines", lambda: ~T.is_noise_line(F.col("line")), f"NOT {noise('line')}", where=True)
line_query("filter_low_value_lines", lambda: ~T.is_low_value_line(F.col("line")), f"NOT {low('line')}", where=True)
line_query("filter_orphan_fragments", lambda: ~T.is_orphan_fragment(F.col("line")), f"NOT {orphan('line')}", where=True)
line_query("filter_toc_lines", lambda: ~T.is_contents_line(F.col("line")), f"NOT {contents('line')}", where=True)
_open = f"NOT {has(trim('line'), '[.!?;:。！？]$')}"
line_query(
    "filter_nav_prefix", lambda: ~T.is_nav_prefix(F.col("line"), F.lit("general provisions")),
    f"""NOT ({trim('line')} = '' OR {key('line')} = 'general provisions' OR {noise('line')}
      OR (starts_with({trim('line')}, '- ') AND {words(trim('line'))} <= 12 AND {_open}) OR ({words(trim('line'))} <= 3 AND {_open}))""",
    where=True,
)
_h = f"regexp_replace(regexp_replace({trim('line')}, '^\\[H[1-6]\\]\\s*', ''), '^#{{1,6}}\\s+', '')"
_h = collapse(f"regexp_replace(regexp_replace({_h}, '\\s+', ' ', 'g'), '^[ -]+|[ -]+$', '', 'g')")
_letters = f"regexp_replace(h, '[^{T.LETTERS}]', '', 'g')"
QUERIES["detect_headings"] = lambda spark, sf_dir: lines(spark, sf_dir).filter(T.is_heading(F.col("line"))).select(
    "doc_id", "pos", T.clean_heading_line(F.col("line")).alias("heading")
)
ORACLES["detect_headings"] = f"""WITH {LINES_SQL}, cleaned AS (SELECT doc_id, pos, {_h} AS h FROM lines)
  SELECT doc_id, pos, h AS heading FROM cleaned WHERE h <> '' AND length(h) <= 140 AND ({has('h', '(?i)^(PART|Schedule|Chapter)\\s+\\d+')}
    OR {has('h', f'^\\d+(?:\\.\\d+)*\\.?\\s+[{T.CAPITALS}]')} OR (length({_letters}) >= 4 AND upper({_letters}) = {_letters}))"""
line_query("line_key", lambda: T.line_key(F.col("line")), key("line"))
line_query("token_estimate", lambda: T.token_estimate(F.col("line")), estimate("line"))
line_query("useful_word_count", lambda: T.useful_word_count(F.col("line")), words("line"))
_cells = f"""array_to_string(list_filter(list_transform(string_split(line, '|'), lambda c: {trim("regexp_replace(c, '\\s*\\(data\\)\\s*', ' ', 'g')")}),
  lambda c: c <> '' AND {key('c')} NOT IN ('data', '(data)')), ' | ')"""
line_query(
    "strip_placeholder_cells", lambda: T.strip_placeholder_cells(F.col("line")),
    f"""CASE WHEN NOT contains(line, '(data)') THEN line WHEN contains(line, '|') THEN {_cells}
      ELSE {trim("regexp_replace(line, '\\s*\\(data\\)\\s*', ' ', 'g')")} END""",
)
line_query("collapse_repeated_phrase", lambda: T.collapse_repeated_phrase(F.col("line")), collapse("line"))
_clean = trim("regexp_replace(line, '^#+\\s*', '')")
line_query("clean_heading", lambda: T.clean_heading(F.col("line")), trim(f"regexp_replace({_clean}, '\\.{{3,}}.*$', '')"))
_w, _left, _right = halves("line")
_s = squeeze("line")
line_query(
    "dedupe_transcript", lambda: T.dedupe_transcript(F.col("line")),
    f"""CASE WHEN len({_w}) > 1 AND len({_w}) % 2 = 0 AND lower({_left}) = lower({_right}) THEN {_left}
      WHEN length({_s}) > 1 AND length({_s}) % 2 = 0 AND lower({trim(f'{_s}[:length({_s}) // 2]')}) = lower({trim(f'{_s}[length({_s}) // 2 + 1:]')})
      THEN {trim(f"{_s}[:length({_s}) // 2]")} ELSE {_s} END""",
)
line_query("query_signature", lambda: T.query_signature(F.col("line")), squeeze("regexp_replace(lower(line), '[^\\p{L}\\p{N}_\\s]', ' ', 'g')"))
line_query("safe_cache_key", lambda: T.safe_key(F.col("line")), "regexp_replace(line, '[^A-Za-z0-9_.-]+', '-', 'g')")
line_query("strip_speech_hints", lambda: T.strip_speech_hints(F.col("line")), "regexp_replace(line, '(\\d[\\d\\s,./-]*)\\s*\\[([^\\]\\[]+)\\]', '\\1', 'g')")
_sentences = f"list_filter(list_transform(string_split(regexp_replace(line, '([.!?。！？])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {trim('s')}), lambda s: s <> '')"
line_query(
    "sentence_split", lambda: {"n": F.size(T.sentences(F.col("line"))).cast("bigint"), "parts": F.array_join(T.sentences(F.col("line")), "¦")},
    {"n": f"len({_sentences})", "parts": f"array_to_string({_sentences}, '¦')"},
)
_skey = f"regexp_replace(lower({squeeze('s')}), '^[.!?。！？]+|[.!?。！？]+$', '', 'g')"
QUERIES["remove_repeated_sentences"] = lambda spark, sf_dir: lines(spark, sf_dir).select(
    "doc_id", "pos", T.no_repeated_sentences(F.col("line")).alias("value")
)
ORACLES["remove_repeated_sentences"] = f"""WITH {LINES_SQL}, parts AS (
    SELECT doc_id, pos, generate_subscripts(p, 1) AS k, unnest(p) AS s FROM (SELECT doc_id, pos, {_sentences} AS p FROM lines)),
  marked AS (SELECT doc_id, pos, k, s, {_skey} AS key, lag({_skey}) OVER (PARTITION BY doc_id, pos ORDER BY k) AS before FROM parts),
  kept AS (SELECT doc_id, pos, string_agg(s, ' ' ORDER BY k) AS value FROM marked WHERE before IS NULL OR key <> before GROUP BY ALL)
  SELECT l.doc_id, l.pos, coalesce(value, '') AS value FROM lines l LEFT JOIN kept USING (doc_id, pos)"""
_bare = trim("regexp_replace(x, '\\b(PART|Schedule)\\s+\\d+[.:]?\\s*', '', 'g')")
_ls = f"list_filter(list_transform(string_split(x, chr(10)), lambda s: {trim('s')}), lambda s: s <> '')"
fixed_query(
    "filter_junk_chunks", CHUNKS, ("documents", "doc_id", "text"), lambda: {"is_junk": T.is_junk_chunk(F.col("x"))},
    {
        "is_junk": f"""({estimate('x')} <= 50 AND ({has(_bare, '^[\\d\\s.]+$')} OR (len({_ls}) >= 3
          AND len(list_filter({_ls}, lambda s: {has('s', '^\\d+\\.?$')})) / len({_ls}) > 0.5)
          OR len(regexp_extract_all(x, '[a-zA-Zа-яА-Я]{{3,}}')) < 3))"""
    },
)
_u = trim("x")
_scheme, _host = f"lower(regexp_extract({_u}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))", "lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
_path = f"regexp_replace(regexp_extract({_u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/{{2,}}', '/', 'g')"
_query = f"""array_to_string(list_filter(string_split(regexp_extract({_u}, '^[^?#]*\\?([^#]*)', 1), '&'),
  lambda p: split_part(p, '=', 1) IN {inside(T.KEPT_QUERY_KEYS)} AND regexp_matches(p, '^[^=]+=.')), '&')"""
fixed_query(
    "canonical_url", URLS, ("pages", "page_id", "url"), lambda: {"canonical": T.canonical_url(F.col("x"))},
    {
        "canonical": f"""CASE WHEN {_u} = '' THEN '' ELSE CASE WHEN {_scheme} IN ('http', 'https') THEN 'https' ELSE {_scheme} END || '://' || {_host.format(u=_u)}
          || CASE WHEN {_path} IN ('', '/') THEN '/' ELSE regexp_replace({_path}, '/+$', '') END
          || CASE WHEN {_query} <> '' THEN '?' || {_query} ELSE '' END END"""
    },
)
fixed_query(
    "filter_bad_urls", URLS, ("pages", "page_id", "url"), lambda: {"is_bad": T.is_bad_url(F.col("x"))},
    {
        "is_bad": """(x = '' OR NOT regexp_matches(x, '(?i)^https?://[^/?#]+')
          OR regexp_matches(regexp_extract(x, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/https?:/'))"""
    },
)
_label = f"split_part(regexp_replace({_host.format(u='x')}, '^www\\.', ''), '.', 1)"
fixed_query(
    "site_label", URLS, ("pages", "page_id", "url"), lambda: {"label": T.site_label(F.lit(""), F.col("x"))},
    {"label": f"CASE WHEN {_label} = '' THEN 'general' ELSE {_label} END"},
)
_slug = "regexp_replace(regexp_replace(regexp_replace(x, '\\.md$', ''), '[^a-zA-Z0-9а-яА-ЯёЁ]+', '-', 'g'), '^-+|-+$', '', 'g')"
_slug = f"left({_slug}, 35) || '-' || left(sha1(x), 4)"
fixed_query("source_slug", FILES, ("documents", "doc_id", "source"), lambda: {"slug": T.source_slug(F.col("x"))}, {"slug": _slug})
fixed_query(
    "chunk_id", FILES, ("documents", "doc_id", "source"),
    lambda: {"chunk_id": T.chunk_id(F.lit("web"), T.source_slug(F.col("x")), F.abs("id"))}, {"chunk_id": f"'web-' || {_slug} || '-' || lpad(abs(id)::VARCHAR, 5, '0')"},
)

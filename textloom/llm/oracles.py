"""The queries of this package in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from .mixing import FRACTIONS, MARGINALS, ROUNDS, TEMPERATURE, TOLERANCE
from .secret_scans import ALPHABET, ASSIGN_HEAD, ASSIGN_VALUE, KINDS, THRESHOLD, TOKEN, labelled_samples, train

SPACES = "chr(9), chr(10), chr(11), chr(12), chr(13)"
#: Words of a text: every kind of white space becomes a blank.
WORDS = "list_filter(string_split(translate(coalesce({0}, ''), concat(" + SPACES + "), '     '), ' '), lambda w: w <> '')"


def words(x: str) -> str:
    return WORDS.replace("{0}", x)


OP1 = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {words('text')} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM rep, range(0, 5) r(j) GROUP BY doc_id),
m AS (SELECT d.doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: len({words('x')}) > 0) AS lines, coalesce(cov.n, 0) AS n_repeat_words FROM d LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
g AS (SELECT *, base_failed OR 10 * n_symbols > word_chars OR 10 * n_dup_lines > 3 * len(lines) AS failed FROM f),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(failed::INT)::DOUBLE AS f FROM g GROUP BY source),
s AS (SELECT count(*) AS k, sum(n) AS n, sum(f * f / n) AS ff, sum(n * n) AS nn, least(greatest(sum(f) / sum(n), 1e-6), 1 - 1e-6) AS p FROM h),
v AS (SELECT p, CASE WHEN n - nn / n > 0 THEN (ff - n * p * p - (k - 1) * p * (1 - p)) / (n - nn / n) ELSE 0 END AS spread FROM s),
b AS (SELECT p, least(greatest(CASE WHEN spread > 0 THEN p * (1 - p) / spread - 1 ELSE 1e300 END, 1.0), 10000.0) AS z FROM v),
r AS (SELECT source, (f + p * z) / (n + z) AS rate FROM h, b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND ln(rate / (1 - rate)) + CASE WHEN failed THEN 3.0 ELSE -3.0 END < 0 AS kept, round(rate, 6) AS host_rate
FROM g JOIN r ON g.source IS NOT DISTINCT FROM r.source"""

OP3 = f"""
WITH d AS (SELECT doc_id, {words('text')} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
late AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM late, range(0, 20) r(j)),
n AS (SELECT doc_id, count(*) AS n, list(i) AS l FROM gone GROUP BY doc_id),
each AS (SELECT doc_id, i, w[i] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)"""

COMPONENTS = """
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT {id} AS id, {id} AS c FROM {table} UNION SELECT e.b, r.c FROM reach r JOIN edges e ON r.id = e.a WHERE r.c < e.b),
comp AS (SELECT id, min(c) AS component_id FROM reach GROUP BY id)"""

OP6 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {words("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * o >= 75 * (p.n + q.n - o)),
{COMPONENTS.format(id='doc_id', table='documents')}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) JOIN comp ON id = d.doc_id"""

OP7 = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND label IS NOT NULL),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id AND len(x.e) = len(y.e)
  WHERE x.n > 0 AND y.n > 0 AND list_inner_product(x.e, y.e) / (x.n * y.n) >= 0.98),
{COMPONENTS.format(id='vec_id', table='embeddings')},
k AS (SELECT a, count(*) AS n FROM edges GROUP BY a)
SELECT vec_id, coalesce(k.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN comp ON id = vec_id LEFT JOIN k ON k.a = vec_id"""


def _pieces(pattern: str, replacement: str) -> str:
    q = pattern.replace("'", "''")
    clean = "translate(t, concat(chr(1), chr(2), chr(3)), concat(chr(4), chr(4), chr(4)))"
    return f"string_split(regexp_replace({clean}, '{q}', {replacement}, 'g'), chr(1))"


def _op8() -> str:
    table = train(labelled_samples())
    weights = ", ".join(str(table[x + y]) for x in ALPHABET for y in ALPHABET)
    patterns = {
        "assign": _pieces(f"({ASSIGN_HEAD})({ASSIGN_VALUE})".replace("\\x20", " "), "concat(chr(1), '\\1', chr(3), '\\2', chr(2))"),
        "access": _pieces("(AKIA[A-Z0-9]{12,})", "concat(chr(1), '\\1', chr(2))"),
        "hex": _pieces("([0-9a-f]{32,})", "concat(chr(1), '\\1', chr(2))"),
        "random": _pieces(f"({TOKEN})", "concat(chr(1), '\\1', chr(2))"),
    }
    parts = " UNION ALL ".join(f"SELECT doc_id, {k} AS k, {patterns[x]} AS p FROM d" for k, x in enumerate(KINDS))
    n = len(ALPHABET)
    code = lambda i: f"(strpos('{ALPHABET}', m[{i}:{i}]) - 1)"
    ratio = f"list_sum(list_transform(range(1, length(m)), lambda i: weights.w[{code('i')} * {n} + {code('i + 1')} + 1]))"
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    text = lambda rows: f"string_agg(concat({names}[k + 1], ':', s, ':', e), ',' ORDER BY s, k, e) FILTER (WHERE {rows})"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), weights AS (SELECT [{weights}] AS w),
parts AS ({parts}),
cut AS (SELECT doc_id, k, generate_subscripts(p, 1) AS i, unnest(p) AS x FROM parts),
bare AS (SELECT doc_id, k, i, x, length(translate(x, concat(chr(2), chr(3)), '')) AS n FROM cut),
placed AS (SELECT doc_id, k, i, split_part(x, chr(2), 1) AS raw, sum(n) OVER (PARTITION BY doc_id, k ORDER BY i) - n AS s FROM bare),
found AS (SELECT doc_id, k, s::BIGINT AS s, (s + length(translate(raw, chr(3), '')))::BIGINT AS e, raw, translate(raw, chr(3), '') AS m FROM placed WHERE i > 1),
base AS (SELECT doc_id, k, s, e FROM found WHERE k IN (1, 2) OR (k = 0 AND length(split_part(raw, chr(3), 2)) >= 8)),
met AS (SELECT r.doc_id, r.s AS ts, r.m, b.s, b.e FROM found r JOIN base b ON b.doc_id = r.doc_id AND b.s < r.e AND b.e > r.s WHERE r.k = 3 UNION ALL SELECT doc_id, s, m, e, e FROM found WHERE k = 3),
left_over AS (SELECT doc_id, ts, m AS whole, greatest(ts, coalesce(max(e) OVER (PARTITION BY doc_id, ts ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ts)) AS a, s AS z FROM met),
part AS (SELECT doc_id, a AS s, z AS e, substr(whole, (a - ts + 1)::BIGINT, (z - a)::BIGINT) AS m FROM left_over WHERE z > a + 1),
more AS (SELECT doc_id, 3 AS k, s, e FROM part, weights WHERE {ratio} >= {THRESHOLD} * (length(m) - 1)),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM more),
agg AS (SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
  count(*) FILTER (WHERE k = 3) AS n_random, {text('k < 3')} AS b, {text('true')} AS a FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_random, 0) AS n_random,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans FROM d LEFT JOIN agg USING (doc_id)"""


def _op9() -> str:
    targets = ",\n".join(
        f"p_{m} AS (SELECT {m}, pow(sum(tokens), {TEMPERATURE}) AS p FROM cells GROUP BY {m}),\nt_{m} AS (SELECT {m}, p / (SELECT sum(p) FROM p_{m}) AS t_{m} FROM p_{m})"
        for m in MARGINALS
    )
    joins = " ".join(f"JOIN t_{m} ON t_{m}.{m} IS NOT DISTINCT FROM cells.{m}" for m in MARGINALS)
    rest = "f, total, source, lang, topic, tokens, t_source, t_lang, t_topic"
    step = "r"
    for m in MARGINALS:
        step = f"(SELECT i, {rest}, share * (t_{m} * (total * f) / sum(share) OVER (PARTITION BY f, {m})) AS share FROM {step})"
    away = ", ".join(f"abs(sum(share) OVER (PARTITION BY f, {m}) / (t_{m} * (total * f)) - 1)" for m in MARGINALS)
    on = " AND ".join(f"rows.{m} IS NOT DISTINCT FROM w.{m}" for m in MARGINALS)
    return f"""
WITH RECURSIVE rows AS (SELECT doc_id, len({words('text')}) AS n_tokens, source, lang, CASE WHEN contains(text, ' | ') THEN 'table'
  WHEN contains(text, 'Licen') THEN 'license' WHEN contains(text, '@') OR contains(text, '+1 (') THEN 'contact' ELSE 'prose' END AS topic
  FROM (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents)),
cells AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM rows GROUP BY ALL HAVING sum(n_tokens) > 0),
{targets},
r AS (SELECT 0 AS i, f, (SELECT sum(tokens) FROM cells) AS total, cells.source, cells.lang, cells.topic, tokens, t_source, t_lang, t_topic, tokens * f AS share
    FROM cells {joins}, (SELECT unnest([{", ".join(f"{f}::DOUBLE" for f in FRACTIONS)}]) AS f)
  UNION ALL SELECT i + 1, {rest}, least(share, tokens) FROM {step} WHERE i < {ROUNDS}),
ends AS (SELECT *, greatest({away}) AS d FROM r WHERE i = {ROUNDS}),
each AS (SELECT f, max(d) AS d FROM ends GROUP BY f),
best AS (SELECT max(f) AS f FROM each WHERE d <= greatest({TOLERANCE}, 1.01 * (SELECT min(d) FROM each))),
w AS (SELECT source, lang, topic, share / tokens AS p FROM ends JOIN best USING (f))
SELECT doc_id, n_tokens, rows.source, rows.lang, rows.topic, round(coalesce(p, 1.0), 6) AS probability,
  ('0x' || md5(doc_id::VARCHAR)[1:13])::BIGINT::DOUBLE / {float(1 << 52)!r} < coalesce(p, 1.0) AS kept
FROM rows LEFT JOIN w ON {on}"""


OP10 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, sha1(html) AS h FROM p),
m AS (SELECT h, max(page_id) AS stored FROM d WHERE n >= 1000 GROUP BY h)
SELECT page_id, n AS payload_bytes, d.h AS payload_digest, CASE WHEN stored <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN stored <> page_id THEN stored END AS refers_to
FROM d LEFT JOIN m ON m.h = d.h AND n >= 1000"""

LOWERED = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT r, doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS x FROM d),
keyed AS (SELECT r, doc_id, i, x, {LOWERED.format("trim(x, concat(' ', " + SPACES + "))")} AS k FROM lines),
gone AS (SELECT k, max(doc_id) AS holder FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT r) >= 5),
judged AS (SELECT r, i, x, holder IS NULL OR doc_id IS NOT DISTINCT FROM holder AS stays FROM keyed LEFT JOIN gone USING (k)),
kept AS (SELECT r, string_agg(x, chr(10) ORDER BY i) FILTER (WHERE stays) AS t, count(*) FILTER (WHERE NOT stays) AS n FROM judged GROUP BY r)
SELECT doc_id, len(l)::BIGINT AS n_lines, n AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256 FROM d JOIN kept USING (r)"""

OP12 = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {words('text')} AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, len(w) < 200 AS A, 100 * len(list_distinct(w)) < 50 * len(w) AS B,
  100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS C, regexp_matches(t, '[#$%&*|]') AS D, coalesce(d.doc_id > first, false) AS E
  FROM d JOIN firsts USING (t) LEFT JOIN l ON l.doc_id = d.doc_id),
x AS (SELECT part, good, toxic, concat(CASE WHEN A THEN 'A' ELSE '' END, CASE WHEN B THEN 'B' ELSE '' END, CASE WHEN C THEN 'C' ELSE '' END,
  CASE WHEN D THEN 'D' ELSE '' END, CASE WHEN E THEN 'E' ELSE '' END) AS fails FROM f),
s AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT concat(a.c, b.c, c.c, d.c, e.c) AS filter_order FROM s a, s b, s c, s d, s e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
r AS (SELECT part, filter_order, step, good, toxic, filter_order[step:step] AS own, contains(fails, filter_order[step:step]) AS bad, fails,
  len(regexp_replace(filter_order[1:step - 1], concat('[^', CASE WHEN fails = '' THEN '-' ELSE fails END, ']'), '', 'g')) > 0 AS gone
  FROM x, o, (SELECT unnest(range(1, 6))::INT AS step)),
n AS (SELECT part, filter_order, step, own, count(*) FILTER (WHERE NOT gone AND NOT bad) AS kept, count(*) FILTER (WHERE bad AND NOT gone) AS removed,
  count(*) FILTER (WHERE bad AND gone) AS redundant, count(*) FILTER (WHERE fails = own) AS unique_fails,
  count(*) FILTER (WHERE bad AND NOT gone AND good) AS good_lost, count(*) FILTER (WHERE bad AND NOT gone AND toxic) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM n"""


def _op13(own: int = 4, above: int = 3) -> str:
    """Unrolled over as many levels within and above the sources as 16**own rows a source and 16**above sources need."""
    field = lambda x: f"coalesce(concat(strlen({x}), ':', {x}), '-')"
    leaf = lambda text: "sha256(concat(" + ", ".join(field(x) for x in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + "))"
    byte = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: {byte}), 4294967295)"
    ctes = [
        f"d AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN ({crc}) % 5 = 0 THEN {leaf(LOWERED.format('text'))} END AS forged FROM documents)",
        "l AS (SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM d)",
        "n0 AS (SELECT source AS g, p, leaf AS h FROM l)",
    ]
    for k in range(own + above):
        if k == own:
            ctes.append(f"n{own}x AS (SELECT g AS source, h AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS q FROM n{k})")
        under = f"(SELECT NULL::VARCHAR AS g, q AS p, subroot AS h FROM n{own}x)" if k == own else f"n{k}"
        ctes.append(f"c{k} AS (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {under})")
        ctes.append(f"n{k + 1} AS (SELECT g, p // 16 AS p, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY p)) END AS h FROM c{k} GROUP BY g, p // 16)")
    ctes.append("f0 AS (SELECT r, l.source, p, q, '' AS s, coalesce(forged, leaf) AS h FROM l JOIN n%dx x ON l.source IS NOT DISTINCT FROM x.source)" % own)
    for k in range(own + above):
        at = "p" if k < own else "q"
        same = "c.g IS NOT DISTINCT FROM f.source" if k < own else "true"
        part = lambda sign: f"coalesce(string_agg(c.h, '' ORDER BY c.p) FILTER (WHERE c.p {sign} f.{at}), '')"
        ctes.append(
            f"f{k + 1} AS (SELECT r, source, {'p // 16 AS p, q' if k < own else 'p, q // 16 AS q'}, concat(s, a, b) AS s, CASE WHEN n = 1 THEN h ELSE sha256(concat(a, h, b)) END AS h FROM "
            f"(SELECT r, f.source, f.p, f.q, f.s, f.h, any_value(n) AS n, {part('<')} AS a, {part('>')} AS b FROM f{k} f JOIN c{k} c ON {same} AND c.p // 16 = f.{at} // 16 GROUP BY ALL))"
        )
    last = own + above
    return "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, leaf, subroot, n{last}.h AS root, sha256(f.s) AS proof_sha256, f.h AS folded_root, f.h = n{last}.h AS verified
FROM l JOIN f{last} f USING (r) JOIN n{own}x x ON x.source IS NOT DISTINCT FROM l.source, n{last}"""


ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": OP1,
    "op3_substring_dedup": OP3,
    "op6_ngram_join": OP6,
    "op7_embedding_dedup": OP7,
    "op8_secret_scans": _op8(),
    "op9_mixing": _op9(),
    "op10_warc": OP10,
    "op11_line_dedup": OP11,
    "op12_filter_audit": OP12,
    "op13_merkle_manifest": _op13(),
}

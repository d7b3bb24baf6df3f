"""Queries of joins, aggregations, windows, set and vector operators, each with the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import ranks, vectors

from .inputs import LINES_SQL, fixed, lines, table, values
from .text_queries import ORACLES as text_oracles
from .text_queries import contents, key, noise, trim, words

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

TABLES = ("documents", "pages", "conversations", "embeddings", "events", "benchmark", "labels")
#: What the two dialects write differently, under a name that a query gives in braces.
SPARK = {"i64": "bigint", "micros": "unix_micros(cast(ts AS timestamp))", "toks": "regexp_extract_all(lower(text), '([a-z]+)', 1)"}
DUCK = {"i64": "BIGINT", "micros": "epoch_us(ts)", "toks": "regexp_extract_all(lower(text), '[a-z]+')"}


def same(name: str, sql: str, oracle: str | None = None) -> None:
    """A query in SQL that both engines read; `oracle` where DuckDB needs other words."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        used = {t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in sql}
        text = sql
        for k, v in SPARK.items():
            text = text.replace(f"{{{k}}}", v)
        return spark.sql(text, **used)

    QUERIES[name] = run
    text = oracle or sql
    for k, v in (DUCK | {t: t for t in TABLES}).items():
        text = text.replace(f"{{{k}}}", v)
    ORACLES[name] = text


def add(name: str, run, oracle: str) -> None:
    QUERIES[name] = run
    ORACLES[name] = oracle


# Joins.
same("join_hits_metadata", "SELECT e.vec_id, e.label, d.source, d.lang FROM {embeddings} e JOIN {documents} d ON e.vec_id = d.doc_id")
same(
    "vector_reuse_diff",
    """SELECT n.lang, count(CASE WHEN o.doc_id IS NULL THEN 1 END) AS missing, count(CASE WHEN o.digest <> n.digest THEN 1 END) AS changed,
         count(CASE WHEN o.digest = n.digest THEN 1 END) AS reused
       FROM (SELECT doc_id, lang, md5(text) AS digest FROM {documents}) n
       LEFT JOIN (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN md5(concat(text, '!')) ELSE md5(text) END AS digest FROM {documents} WHERE doc_id % 3 <> 0) o
         ON n.doc_id = o.doc_id GROUP BY n.lang""",
)
same(
    "route_files",
    """SELECT d.doc_id, d.source, r.domain, r.strategy FROM {documents} d
       JOIN (SELECT * FROM (VALUES ('src0', 'web', 'web'), ('src1', 'policy', 'policy'), ('src2', 'report', 'report'), ('src3', 'faq', 'faq'), ('src4', 'guide', 'single')) r(name, domain, strategy)) r
         ON d.source = r.name""",
)
same("anti_missing_targets", "SELECT d.doc_id, d.source FROM {documents} d LEFT ANTI JOIN {labels} l ON d.doc_id = l.doc_id",
     "SELECT d.doc_id, d.source FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id")
add(
    "dedupe_chunks_first",
    lambda spark, sf_dir: table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).select("doc_id", "n"),
    "SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY sha256(text)",
)
same(
    "union_dedupe_sources",
    """SELECT text, min(kind) AS kind, count(*) AS n FROM (SELECT text, 'benchmark' AS kind FROM {benchmark} UNION ALL SELECT text, 'turn' AS kind FROM {conversations}) u GROUP BY text""",
)


def _faq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best question for every user turn by token overlap: tokens join, so pairs that share none are never made."""
    side = lambda df, i: df.select(F.col(i).alias("i"), F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("t")).withColumn("n", F.size("t"))
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    q, f = side(turns, "id"), side(table(spark, sf_dir, "benchmark"), "item_id")
    q, f = (x.select(F.col("i").alias(a), F.col("n").alias(b), F.explode("t").alias("t")) for x, a, b in ((q, "id", "nq"), (f, "item_id", "nf")))
    score = F.count("*") / (F.col("nq") + F.col("nf") - F.count("*"))
    pairs = q.join(f, "t").groupBy("id", "item_id", "nq", "nf").agg(score.alias("score"))
    best = ranks.first_of_each(pairs.select("id", "item_id", "score"), ["id"], [-F.col("score"), F.col("item_id")])
    return best.select("id", "item_id", F.round("score", 6).alias("score"))


_toks = "list_distinct(regexp_extract_all(lower(text), '[a-z]+'))"
add(
    "faq_jaccard_match", _faq,
    f"""WITH q AS (SELECT conv_id * 1000 + turn AS id, {_toks} AS t FROM conversations WHERE role = 'user'), f AS (SELECT item_id, {_toks} AS t FROM benchmark),
      s AS (SELECT id, item_id, len(list_intersect(q.t, f.t))::DOUBLE / len(list_distinct(list_concat(q.t, f.t))) AS score FROM q, f WHERE len(list_intersect(q.t, f.t)) > 0)
      SELECT id, item_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, item_id) = 1""",
)
same(
    "repeated_question_match",
    """WITH t AS (SELECT conv_id, turn, conv_id * 1000 + turn AS id, lower(trim(text)) AS k FROM {conversations} WHERE role = 'user')
       SELECT id, hit FROM (SELECT id, max(id) OVER (PARTITION BY k ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hit FROM t) x WHERE id - hit <= 1800000""",
)

# Aggregations.
same(
    "chunk_stats_rollup",
    """SELECT coalesce(lang, 'TOTAL') AS domain, count(*) AS n, cast(floor(avg(t)) AS {i64}) AS avg_tokens, min(t) AS min_tokens, max(t) AS max_tokens
       FROM (SELECT lang, greatest(1, cast(floor(length(text) / 4) AS {i64})) AS t FROM {documents}) x GROUP BY ROLLUP (lang)""",
)
same("ingest_stats", """SELECT source, count(*) AS n, sum(CASE WHEN length(text) < 200 THEN 1 ELSE 0 END) AS short_texts, sum(CASE WHEN text LIKE '%License%' THEN 1 ELSE 0 END) AS licensed,
       cast(sum(n_chars) AS {i64}) AS chars FROM {documents} GROUP BY source""",
     """SELECT source, count(*) AS n, sum(CASE WHEN length(text) < 200 THEN 1 ELSE 0 END)::BIGINT AS short_texts, sum(CASE WHEN text LIKE '%License%' THEN 1 ELSE 0 END)::BIGINT AS licensed,
       sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source""")
same(
    "topic_counts_topk",
    """SELECT conv_id, token, n FROM (SELECT conv_id, token, n, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, token) AS r FROM
         (SELECT conv_id, token, count(*) AS n FROM (SELECT DISTINCT conv_id, turn, explode({toks}) AS token FROM {conversations}) t WHERE length(token) >= 4 GROUP BY conv_id, token) c) x WHERE r <= 8""",
    """SELECT conv_id, token, n FROM (SELECT conv_id, token, n, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, token) AS r FROM
         (SELECT conv_id, token, count(*) AS n FROM (SELECT DISTINCT conv_id, turn, unnest({toks}) AS token FROM conversations) t WHERE length(token) >= 4 GROUP BY conv_id, token) c) x WHERE r <= 8""",
)
same(
    "turn_latency_pivot",
    """SELECT user_id, min(CASE WHEN event_type = 'view' THEN {micros} END) AS first_view, min(CASE WHEN event_type = 'click' THEN {micros} END) AS first_click,
         min(CASE WHEN event_type = 'purchase' THEN {micros} END) AS first_purchase,
         min(CASE WHEN event_type = 'purchase' THEN {micros} END) - min(CASE WHEN event_type = 'view' THEN {micros} END) AS view_to_purchase
       FROM {events} GROUP BY user_id""",
)
same("best_chunk_score", """SELECT user_id, max(coalesce(CASE WHEN event_type = 'click' THEN value END, CASE WHEN value > 50 THEN value / 2 END, 0.0)) AS score FROM {events} GROUP BY user_id""")
same(
    "citations_topn",
    """SELECT conv_id, role, first_turn FROM (SELECT conv_id, role, first_turn, row_number() OVER (PARTITION BY conv_id ORDER BY first_turn) AS r
         FROM (SELECT conv_id, role, min(turn) AS first_turn FROM {conversations} GROUP BY conv_id, role) f) x WHERE r <= 4""",
)
add(
    "centroid_mean_pool",
    lambda spark, sf_dir: _centroids(table(spark, sf_dir, "embeddings")),
    """WITH m AS (SELECT label, i, avg(x) AS x FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label, i)
      SELECT label, i, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM m""",
)


def _centroids(df: DataFrame) -> DataFrame:
    """Mean vector of every label, of length 1, a row per dimension."""
    means = df.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    length = F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy("label")))
    return means.select("label", F.col("i").cast("bigint").alias("i"), F.round(F.col("x") / length, 6).alias("x"))


#: Pages with a running header and footer, and texts with headings, so that the rules fire.
EDGES = tuple(f"The running header\npage text {k}\n" + "\n".join(f"line {k} {i}" for i in range(8)) + ("\n- THE FOOTER line" if k % 2 else "\nend") for k in range(8))
HEADED = ("lead line\nsecond\n[H2] Heading\nbody", "[H4] no cut\nbody\n[H1] cut here", "none at all", "[H3] at once\nx")


def _edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that come among the first or last four of three or more documents of a source, and of a quarter or more."""
    own = fixed(spark, EDGES).select(F.lit("own").alias("source"), (-F.col("n") - 1).alias("doc_id"), F.split("x", "\n", -1).alias("l"))
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.split("text", "\n", -1).alias("l")).union(own)
    edge = F.concat(F.slice("l", 1, 4), F.slice("l", F.greatest(F.size("l") - 3, F.lit(1)), 4))
    rows = docs.select("source", F.explode(edge).alias("line")).select("source", T.line_key(F.col("line")).alias("key"))
    pages = docs.groupBy("source").agg(F.count("*").alias("pages"))
    counted = rows.filter(F.length("key").between(5, 90)).groupBy("source", "key").agg(F.count("*").alias("n"))
    return counted.join(pages, "source").filter((F.col("n") >= 3) & (F.col("n") >= F.floor(F.col("pages") / 4))).select("source", "key", "n")


add(
    "repeated_edge_lines", _edge_lines,
    f"""WITH d AS (SELECT source, string_split(text, chr(10)) AS l FROM documents UNION ALL SELECT 'own', string_split(x, chr(10)) FROM {values(EDGES)}), p AS (SELECT source, count(*) AS pages FROM d GROUP BY source),
      e AS (SELECT source, unnest(list_concat(l[1:4], l[greatest(len(l) - 3, 1):])) AS line FROM d),
      c AS (SELECT source, key, count(*) AS n FROM (SELECT source, {key('line')} AS key FROM e) WHERE length(key) BETWEEN 5 AND 90 GROUP BY ALL)
      SELECT c.source, key, n FROM c JOIN p USING (source) WHERE n >= 3 AND n >= pages // 4""",
)
add(
    "toc_block_ratio",
    lambda spark, sf_dir: lines(spark, sf_dir).filter(T.trimmed(F.col("line")) != "").groupBy("doc_id").agg(
        F.count("*").alias("n"), F.sum(T.is_contents_line(F.col("line")).cast("bigint")).alias("n_toc"), F.sum(T.is_noise_line(F.col("line")).cast("bigint")).alias("n_noise")
    ).withColumn("is_toc", (F.col("n") >= 3) & (F.col("n_toc") * 10 > F.col("n") * 4)),
    f"""WITH {LINES_SQL}, c AS (SELECT doc_id, count(*) AS n, sum({contents('line')}::INT)::BIGINT AS n_toc, sum((NOT kept)::INT)::BIGINT AS n_noise FROM
      (SELECT *, NOT ({noise('line')}) AS kept FROM lines WHERE {trim('line')} <> '') GROUP BY doc_id) SELECT *, n >= 3 AND n_toc * 10 > n * 4 AS is_toc FROM c""",
)
same("events_tumbling_count", """SELECT event_type, cast(floor({micros} / 3600000000) AS {i64}) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM {events} GROUP BY 1, 2""")
same("sink_partitioned_counts", "SELECT lang, source, count(*) AS n FROM {documents} GROUP BY lang, source")

# Windows and order.
add(
    "line_dedupe_first",
    lambda spark, sf_dir: lines(spark, sf_dir).withColumn("key", T.line_key(F.col("line"))).groupBy("doc_id", F.when(F.length("key") > 3, F.col("key")).otherwise(F.concat(F.lit("#"), F.col("pos"))).alias("k"))
    .agg(F.min(F.struct("pos", "line")).alias("first")).select("doc_id", "first.pos", "first.line"),
    f"""WITH {LINES_SQL} SELECT doc_id, pos, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, CASE WHEN length({key('line')}) > 3 THEN {key('line')} ELSE '#' || pos END ORDER BY pos) AS r FROM lines) WHERE r = 1""",
)
SAME_PAGES = ("two words", "four words are here", "four words are there", "x")
ORACLE_URLS = text_oracles["canonical_url"]
add(
    "best_per_url",
    lambda spark, sf_dir: ranks.first_of_each(
        table(spark, sf_dir, "pages").select(T.canonical_url(F.col("url")).alias("url"), "page_id", T.useful_word_count(F.col("html")).alias("n")).union(
            fixed(spark, SAME_PAGES).select(T.canonical_url(F.lit("http://Own.example/a/")), (-F.col("n") - 1), T.useful_word_count(F.col("x")))
        ),
        ["url"], [-F.col("n"), F.col("page_id")],
    ),
    f"""SELECT url, page_id, n FROM (SELECT canonical AS url, id AS page_id, n FROM ({ORACLE_URLS}) JOIN (SELECT page_id AS id, {words('html')} AS n FROM pages) USING (id)
      UNION ALL SELECT 'https://own.example/a', -n - 1, {words('x')} FROM {values(SAME_PAGES)}) QUALIFY row_number() OVER (PARTITION BY url ORDER BY n DESC, page_id) = 1""",
)
same("forward_fill", """SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM {events}""",
     """SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events""")
same("change_points", """SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM {events}) x WHERE before IS NULL OR before <> event_type""")
same("last_n_history", """SELECT conv_id, turn, role, r FROM (SELECT conv_id, turn, role, cast(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS {i64}) AS r FROM {conversations}) x WHERE r <= 6""")
same("chunk_numbering", """SELECT conv_id, turn, cast(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS {i64}) AS chunk_index FROM {conversations}""")
add(
    "batch_assign",
    lambda spark, sf_dir: ranks.global_row_number(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("doc_id", F.floor(F.col("n") / 64).alias("batch"), (F.col("n") % 64).alias("at")),
    "SELECT doc_id, n // 64 AS batch, n % 64 AS at FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents)",
)
add(
    "point_id_positional",
    lambda spark, sf_dir: ranks.global_row_number(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id", name="point_id"),
    "SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS point_id FROM embeddings",
)
def _headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fixed(spark, HEADED).select((-F.col("n") - 1001).alias("doc_id"), F.posexplode(F.split("x", "\n", -1)).alias("pos", "line"))
    return lines(spark, sf_dir).union(own)


add(
    "cut_before_first_heading",
    lambda spark, sf_dir: _headed(spark, sf_dir).withColumn("first", F.min(F.when(F.col("line").rlike(r"^\[H[1-3]\]"), F.col("pos"))).over(W.partitionBy("doc_id")))
    .filter(F.col("pos") >= F.coalesce("first", F.lit(0))).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("pos").alias("start")),
    f"""WITH {LINES_SQL}, h AS (SELECT * FROM lines UNION ALL SELECT -n - 1001, generate_subscripts(l, 1) - 1, unnest(l) FROM (SELECT n, string_split(x, chr(10)) AS l FROM {values(HEADED)}))
      SELECT doc_id, count(*) AS n, min(pos) AS start FROM (SELECT *, min(CASE WHEN regexp_matches(line, '^\\[H[1-3]\\]') THEN pos END) OVER (PARTITION BY doc_id) AS f FROM h)
      WHERE pos >= coalesce(f, 0) GROUP BY doc_id""",
)
same("sort_pages", "SELECT doc_id, lang, source FROM {documents} ORDER BY lang, source, doc_id")
same("string_caps", "SELECT doc_id, left(text, 120) AS title, left(text, 180) AS preview, length(left(text, 500)) AS n FROM {documents}",
     "SELECT doc_id, left(text, 120) AS title, left(text, 180) AS preview, length(left(text, 500))::INTEGER AS n FROM documents")
same("paginate_range", "SELECT doc_id, source FROM {documents} ORDER BY doc_id LIMIT 500 OFFSET 120")
same("sessionize_idle_30m", """SELECT user_id, session, count(*) AS n, min(t) AS start, max(t) AS stop FROM (SELECT user_id, t, cast(sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id) AS {i64}) AS session
       FROM (SELECT user_id, event_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) <= 1800000000 THEN 0 ELSE 1 END AS new FROM
         (SELECT user_id, event_id, {micros} AS t FROM {events}) e) m) s GROUP BY user_id, session""")
same("dedupe_within_session", """SELECT user_id, event_type, min(event_id) AS event_id FROM {events} GROUP BY user_id, event_type""")
same("ignore_window_gate", """SELECT event_id, user_id FROM (SELECT event_id, user_id, event_type, t, max(CASE WHEN event_type = 'error' THEN t + 600000000 END) OVER (PARTITION BY user_id ORDER BY t, event_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM (SELECT event_id, user_id, event_type, {micros} AS t FROM {events}) e) x WHERE until IS NULL OR t >= until""")
same("microbatch_assign", """SELECT conv_id, turn, CASE WHEN turn = first THEN 0 ELSE cast(floor((r - 2) / 3) AS {i64}) + 1 END AS batch FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r,
       min(turn) OVER (PARTITION BY conv_id) AS first FROM {conversations}) x""")
same("first_act_by_user", """SELECT user_id, event_type, event_id FROM (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM {events} WHERE event_type IN ('click', 'purchase') AND value > 1) x WHERE r = 1""")
same("stale_value_filter", """SELECT event_id, user_id FROM (SELECT event_id, user_id, event_type, value, last_value(CASE WHEN event_type = 'view' THEN value END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS active FROM {events}) x WHERE event_type = 'view' OR value <= active""",
     """SELECT event_id, user_id FROM (SELECT event_id, user_id, event_type, value, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS active FROM events) x WHERE event_type = 'view' OR value <= active""")
same("stream_route_by_id", """SELECT e.event_id, l.toxic FROM {events} e JOIN {labels} l ON e.user_id = l.doc_id""")
same("inorder_release", """SELECT conv_id, turn FROM (SELECT conv_id, turn, min(CASE WHEN length(text) < 40 THEN turn END) OVER (PARTITION BY conv_id) AS missing FROM {conversations}) x WHERE missing IS NULL OR turn < missing""")

# Vectors.
add(
    "vector_normalize",
    lambda spark, sf_dir: table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(vectors.unit(F.col("embedding"))).alias("i", "x")).select("vec_id", F.col("i").cast("bigint").alias("i"), F.round("x", 6).alias("x")),
    """SELECT vec_id, generate_subscripts(v, 1) - 1 AS i, unnest(list_transform(v, lambda x: round(x / n, 6))) AS x
      FROM (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)""",
)
_scored = """scored AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0)"""


def _search(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vectors.top_k(rows.filter("id % 50 = 0"), rows, k)


_shown = ["query_id", "id", "round(score, 4) AS score", "cast(rank AS bigint) AS rank"]
_ranked = f"WITH {_scored}, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored)"
add("vector_topk", lambda spark, sf_dir: _search(spark, sf_dir).selectExpr(*_shown), f"{_ranked} SELECT query_id, id, round(score, 4) AS score, rank FROM ranked WHERE rank <= 20")
add(
    "vector_topk_threshold", lambda spark, sf_dir: _search(spark, sf_dir).filter("score >= 0.2 and query_id <> id").selectExpr(*_shown),
    f"{_ranked} SELECT query_id, id, round(score, 4) AS score, rank FROM ranked WHERE rank <= 20 AND score >= 0.2 AND query_id <> id",
)
add(
    "cosine_scores",
    lambda spark, sf_dir: table(spark, sf_dir, "embeddings").alias("a").join(table(spark, sf_dir, "embeddings").alias("b"), F.expr("b.vec_id = a.vec_id + 1"))
    .select(F.col("a.vec_id").alias("vec_id"), F.round(vectors.dot(F.col("a.embedding"), F.col("b.embedding")), 6).alias("score")),
    "SELECT a.vec_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
)


def _rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the search, scored again by label agreement on top of the first score; the best five."""
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    hits = _search(spark, sf_dir).join(labels, "id").join(labels.select(F.col("id").alias("query_id"), F.col("label").alias("own")), "query_id")
    score = 1 / (1 + F.exp(-(F.col("score") + F.when(F.col("label") == F.col("own"), 0.5).otherwise(0.0))))
    order = W.partitionBy("query_id").orderBy(F.desc("s"), "rank")
    return hits.withColumn("s", score).withColumn("r", F.row_number().over(order)).filter("r <= 5").select("query_id", "id", F.round("s", 6).alias("score"), F.col("r").cast("bigint").alias("rank"))


add(
    "rerank_topn", _rerank,
    f"""{_ranked}, s AS (SELECT r.query_id, r.id, r.rank, 1 / (1 + exp(-(score + CASE WHEN a.label = b.label THEN 0.5 ELSE 0.0 END))) AS s FROM ranked r
        JOIN embeddings a ON a.vec_id = r.id JOIN embeddings b ON b.vec_id = r.query_id WHERE rank <= 20)
      SELECT query_id, id, round(s, 6) AS score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank) AS r FROM s) WHERE r <= 5""",
)


def retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents for every query vector, with their source and the start of their text."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", F.left("text", F.lit(180)).alias("preview"))
    return _rerank(spark, sf_dir).join(docs, "id").select("query_id", "rank", "id", "score", "source", "preview")


add(
    "retrieve", retrieve,
    ORACLES["rerank_topn"].replace("SELECT query_id, id, round(s, 6) AS score, r AS rank FROM (", "SELECT query_id, r AS rank, id, round(s, 6) AS score, source, left(text, 180) AS preview FROM (")
    .replace(") WHERE r <= 5", ") x JOIN documents ON doc_id = id WHERE r <= 5"),
)
same("index_integrity_check", "SELECT count(*) AS n, sum(CASE WHEN size(embedding) = 64 THEN 0 ELSE 1 END) AS wrong_size, count(DISTINCT vec_id) AS ids FROM {embeddings}",
     "SELECT count(*) AS n, sum(CASE WHEN len(embedding) = 64 THEN 0 ELSE 1 END)::BIGINT AS wrong_size, count(DISTINCT vec_id) AS ids FROM embeddings")
same("scan_vectors_dim_filter", "SELECT vec_id, label FROM {embeddings} WHERE size(embedding) = 64", "SELECT vec_id, label FROM embeddings WHERE len(embedding) = 64")
same("sigmoid", "SELECT event_id, round(1 / (1 + exp(-value / 100)), 6) AS p FROM {events}")

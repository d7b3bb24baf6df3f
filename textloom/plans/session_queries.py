"""Queries of sessions: the answer cache, utterances, interrupts, turns, voice chunks, conversations and the answer race, with
DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import language as L
from textloom.functions import text as T
from textloom.operators import cache, dialogue, folds, gating, race, voice
from textloom.sources import shared
from textloom.streaming import folded

from .inputs import table
from .language_queries import language

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# The answer cache: users' turns as questions, and two thirds of them asked again without their last word, a third while
# the first answer is alive and a third when it is too old. Each server's cache sees the conversations of its own sessions.
SESSIONS = 200


def _asked(turns: DataFrame) -> DataFrame:
    turns = turns.filter("role = 'user'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.expr(f"conv_id div {SESSIONS}").alias("server"),
        (F.col("conv_id") * 2.0 + F.col("turn") * 0.25).alias("at"), "text", (F.col("conv_id") % 3).alias("k"),
    )
    later = F.when(F.col("k") == 0, 300.0).otherwise(2000.0)
    again = turns.filter("k < 2").select(F.col("id") + 500, "server", F.col("at") + later, F.regexp_replace("text", r"\s+\S+\s*$", ""), "k")
    return turns.union(again).select("id", "server", "at", L.detect_language(F.col("text")).alias("language"), T.token_set(F.col("text")).alias("tokens"))


def _lru(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = folds.in_order(_asked(table(spark, sf_dir, "conversations")), ["server"], ["at", "id"], cache.AnswerCache())
    return found.select("id", "hit", F.round("score", 6).alias("score"), "n_entries")


def _alive(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _asked(table(spark, sf_dir, "conversations"))
    return cache.alive_matches(asked, asked).select("id", "hit", F.round("score", 6).alias("score"))


_TOKENS = "list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')))"
_ASKED = f"""turns AS (SELECT conv_id * 1000 + turn AS id, conv_id // {SESSIONS} AS server, (conv_id * 2.0 + turn * 0.25)::DOUBLE AS tm, text, conv_id % 3 AS k
    FROM conversations WHERE role = 'user'),
  asked AS (SELECT id, server, tm, {language('text')} AS lang, {_TOKENS} AS t FROM
    (SELECT id, server, tm, text FROM turns UNION ALL
     SELECT id + 500, server, tm + CASE WHEN k = 0 THEN 300 ELSE 2000 END, regexp_replace(text, '\\s+\\S+\\s*$', '') FROM turns WHERE k < 2))"""
_JACCARD = "CASE WHEN len({0}) = 0 AND len({1}) = 0 THEN 1.0 ELSE len(list_intersect({0}, {1}))::DOUBLE / len(list_distinct(list_concat({0}, {1}))) END"
QUERIES["lru_cache_state"] = _lru
ORACLES["lru_cache_state"] = f"""WITH RECURSIVE {_ASKED},
  q AS (SELECT *, row_number() OVER (PARTITION BY server ORDER BY tm, id) AS n FROM asked),
  s AS (
    SELECT DISTINCT server, 0::BIGINT AS n, []::STRUCT(id BIGINT, tm DOUBLE, lang VARCHAR, t VARCHAR[])[] AS e, NULL::BIGINT AS id, NULL::BIGINT AS hit, 0.0::DOUBLE AS score FROM q
    UNION ALL
    SELECT server, n, CASE WHEN hit IS NULL THEN list_append(moved, own)[-{cache.MOST}:] ELSE moved END, id, hit, score FROM (
      SELECT *, CASE WHEN score >= {cache.WIN} AND moved[-1].lang = own.lang THEN moved[-1].id END AS hit FROM (
        SELECT *, CASE WHEN score > 0 THEN list_append(list_filter(alive, lambda x, i: i <> best), alive[best]) ELSE alive END AS moved FROM (
          SELECT *, coalesce(list_max(scores), 0.0) AS score, list_position(scores, list_max(scores)) AS best FROM (
            SELECT *, list_transform(alive, lambda x: {_JACCARD.format('x.t', 'own.t')}) AS scores FROM (
              SELECT q.server, q.n, q.id, {{'id': q.id, 'tm': q.tm, 'lang': q.lang, 't': q.t}} AS own, list_filter(s.e, lambda x: q.tm - x.tm <= {cache.TTL_S}) AS alive
              FROM s JOIN q ON q.server = s.server AND q.n = s.n + 1))))))
  SELECT id, hit, round(score, 6) AS score, len(e)::INT AS n_entries FROM s WHERE n > 0"""
QUERIES["semantic_cache_match"] = _alive
ORACLES["semantic_cache_match"] = f"""WITH {_ASKED}
  SELECT q.id, e.id AS hit, round({_JACCARD.format('q.t', 'e.t')}, 6) AS score FROM asked q JOIN asked e ON q.lang = e.lang AND e.tm < q.tm AND q.tm - e.tm <= {cache.TTL_S}
  WHERE {_JACCARD.format('q.t', 'e.t')} >= {cache.WIN} QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY {_JACCARD.format('q.t', 'e.t')} DESC, e.tm, e.id) = 1"""

# Voice chunks of assistants' turns: at once, and as a stream of deltas. Streams keep the states of neighbouring conversations
# together.
_GROUP = "conv_id div 32"


def _deltas(turns: DataFrame) -> DataFrame:
    """Assistants' turns cut into deltas of 5 to 11 characters, and a last one without text."""
    size = (F.col("turn") % 7 + 5).cast("string")
    parts = F.regexp_extract_all("text", F.concat(F.lit("(?s).{1,"), size, F.lit("}")), F.lit(0))
    # Before the cut, as it would be told again for each delta otherwise.
    turns = turns.filter("role = 'assistant'").select("conv_id", "turn", "text", L.detect_language(F.col("text")).alias("language"))
    turns = turns.select("conv_id", "turn", "language", F.posexplode(F.concat(parts, F.array(F.lit("")))).alias("seq", "delta"))
    ts = F.timestamp_micros(F.lit(1_700_000_000_000_000) + (F.col("conv_id") * 60 + F.col("turn")) * 1_000_000 + F.col("seq") * 1000)
    return turns.withColumn("last", F.col("delta") == "").withColumn("ts", ts)


def _voice(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select(
        "conv_id", "turn", F.col("text").alias("delta"), L.detect_language(F.col("text")).alias("language"), F.lit(True).alias("last")
    )
    return folds.in_order(whole, ["conv_id", "turn"], [], voice.VoiceChunks())


QUERIES["voice_chunks"] = _voice
QUERIES["voice_chunks_stream"] = lambda spark, sf_dir: shared.bounded_stream(
    spark, f"{sf_dir}/conversations.parquet", lambda turns: folded.in_order(_deltas(turns), ["conv_id", "turn"], ["seq"], voice.VoiceChunks(), group=_GROUP)
)

# Utterances: users' turns as tokens of speech. Each word comes first as a guess, every 17th is unsure; `<end>` closes the
# turn. In even turns the service then says all again and closes with `<fin>` and `<end>`. An assistant's turn resets.


def _spoken(turns: DataFrame) -> DataFrame:
    words = F.array_remove(F.split(F.col("text"), r"\s+", -1), "")
    word = lambda x, k, final: F.struct(F.lit("token").alias("kind"), F.concat(F.lit(" "), x).alias("text"), F.lit(final).alias("is_final"), F.when(k % 17 == 16, 0.4).when(k % 3 > 0, 0.9).alias("confidence"))
    mark = lambda x: F.array(F.struct(F.lit("token").alias("kind"), F.lit(x).alias("text"), F.lit(True).alias("is_final"), F.lit(None).cast("double").alias("confidence")))
    reset = F.array(F.struct(F.lit("reset").alias("kind"), F.lit(None).cast("string").alias("text"), F.lit(False).alias("is_final"), F.lit(None).cast("double").alias("confidence")))
    finals = F.transform(words, lambda x, k: word(x, k, True))
    said = F.concat(F.transform(words, lambda x, k: word(x, k, False)), finals, mark("<end>"))
    twice = F.concat(said, finals, mark("<fin>"), finals, mark("<end>"))
    tokens = F.when(F.col("role") == "user", F.when(F.col("turn") % 2 == 0, twice).otherwise(said)).otherwise(reset)
    rows = turns.withColumn("language", L.detect_language(F.col("text"))).select("conv_id", "turn", "language", F.posexplode(tokens).alias("k", "x"))
    ts = F.timestamp_micros(F.lit(1_700_000_000_000_000) + (F.col("conv_id") * 60 + F.col("turn")) * 1_000_000 + F.col("k") * 100)
    return rows.select("conv_id", "turn", "k", "language", "x.*", ts.alias("ts"))


QUERIES["token_assembly"] = lambda spark, sf_dir: shared.bounded_stream(
    spark, f"{sf_dir}/conversations.parquet", lambda turns: folded.in_order(_spoken(turns), ["conv_id"], ["turn", "k"], dialogue.Utterances(), group=_GROUP)
)
ORACLES["token_assembly"] = f"""WITH t AS (SELECT conv_id, turn, role, {language('text')} AS language, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM conversations),
  sure AS (SELECT conv_id, turn, role, language, array_to_string(list_filter(w, lambda x, i: (i - 1) % 17 <> 16), ' ') AS said FROM t),
  marks AS (SELECT conv_id, turn, 1 AS n, '<end>' AS marker, language, said FROM sure WHERE role = 'user'
    UNION ALL SELECT conv_id, turn, n, marker, language, said FROM sure, (VALUES (2, '<fin>'), (3, '<end>')) v(n, marker) WHERE role = 'user' AND turn % 2 = 0),
  r AS (SELECT conv_id, turn, 0 AS n, NULL AS marker, NULL AS language, NULL AS said FROM t WHERE role <> 'user' UNION ALL SELECT * FROM marks),
  g AS (SELECT *, count(*) FILTER (WHERE marker IS NULL) OVER (PARTITION BY conv_id ORDER BY turn, n) AS life FROM r),
  u AS (SELECT *, row_number() OVER (PARTITION BY conv_id, life, trim(lower(regexp_replace(said, '\\s+', ' ', 'g'))) ORDER BY turn, n) = 1 AS appended FROM g WHERE marker IS NOT NULL AND said <> ''),
  f AS (SELECT *, appended AND marker = '<end>' AS able FROM u)
  SELECT conv_id, said AS utterance, language, marker, appended, able AND count(*) FILTER (WHERE able) OVER (PARTITION BY conv_id, life ORDER BY turn, n) = 1 AS finalised FROM f"""

# Interrupts: of a group of users, views open the gate (a turn begins), clicks try to interrupt it. Hours stand between a
# user's events, so the cooldown is ten minutes here.
COOLDOWN_S, GROUPS = 600.0, 10


def _group_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", (F.col("user_id") % GROUPS).alias("session"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), "event_type", "value"
    )


def _gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _group_events(spark, sf_dir)
    kind = F.col("event_type")
    passed = gating.gated(events, "session", "at", ["at", "event_id"], kind == "click", kind == "view", COOLDOWN_S, 6 * gating.PIECE_S)
    return passed.filter("passed").select("session", "event_id")


QUERIES["interrupt_gate"] = _gate
ORACLES["interrupt_gate"] = f"""WITH RECURSIVE e AS (SELECT event_id, user_id % {GROUPS} AS session, epoch_us(ts) / 1e6 AS tm, event_type AS kind FROM events),
  n AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY tm, event_id) AS n FROM e),
  v AS (SELECT *, max(CASE WHEN kind = 'view' THEN n END) OVER (PARTITION BY session ORDER BY n) AS opened FROM n),
  a AS (SELECT session, min(n) AS n, min(tm) AS tm FROM v WHERE kind = 'click' GROUP BY session
    UNION ALL SELECT session, n, tm FROM (SELECT a.session, arg_min(v.n, v.n) AS n, min(v.tm) AS tm FROM a JOIN v ON v.session = a.session AND v.n > a.n
      WHERE v.kind = 'click' AND v.tm >= a.tm + {COOLDOWN_S} AND v.opened > a.n GROUP BY a.session, a.n))
  SELECT a.session, v.event_id FROM a JOIN v ON v.session = a.session AND v.n = a.n"""

# Turns: a view starts a turn, a purchase ends the one it names, clicks name the turn they belong to. What an event names is
# the latest start or, where its value says so, an older one, or none.


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _group_events(spark, sf_dir)
    kind = F.when(F.col("event_type") == "view", "start").when(F.col("event_type") == "purchase", "end").otherwise("event")
    e = e.select("session", "at", F.col("event_id").alias("seq"), kind.alias("kind"), (F.floor("value") % 4).alias("k"))
    starts = gating.carried(e, "session", "at", ["at", "seq"], F.when(F.col("kind") == "start", F.col("seq")), "latest", 6 * gating.PIECE_S)
    turn = F.when(F.col("kind") == "start", F.col("seq")).when(F.col("k") == 0, F.col("latest") - 7).when(F.col("k") < 3, F.col("latest"))
    return starts.withColumn("turn", turn).drop("latest", "k")


QUERIES["stale_turn_filter"] = lambda spark, sf_dir: gating.active_turns(_turns(spark, sf_dir), piece_s=6 * gating.PIECE_S).select("seq", "active", "kept")
ORACLES["stale_turn_filter"] = f"""WITH e AS (SELECT user_id % {GROUPS} AS session, epoch_us(ts) / 1e6 AS tm, event_id AS seq,
    CASE event_type WHEN 'view' THEN 'start' WHEN 'purchase' THEN 'end' ELSE 'event' END AS kind, floor(value)::BIGINT % 4 AS k FROM events),
  l AS (SELECT *, last_value(CASE WHEN kind = 'start' THEN seq END IGNORE NULLS) OVER (PARTITION BY session ORDER BY tm, seq) AS latest FROM e),
  t AS (SELECT *, CASE WHEN kind = 'start' THEN seq WHEN k = 0 THEN latest - 7 WHEN k < 3 THEN latest END AS turn FROM l),
  m AS (SELECT *, CASE WHEN kind = 'start' THEN turn WHEN kind = 'end' AND (turn IS NULL OR turn = latest) THEN -1 END AS mark FROM t),
  a AS (SELECT *, nullif(last_value(mark IGNORE NULLS) OVER (PARTITION BY session ORDER BY tm, seq), -1) AS active FROM m)
  SELECT seq, active, kind IN ('start', 'end') OR turn IS NULL OR active IS NULL OR turn = active AS kept FROM a"""

# Conversations as a client sees them: a user's turn is a message; an assistant's is an answer that starts, is streamed in
# pieces and, two times in three, ends with its payload; some are interrupted. A system's turn sets the language or resets.
PIECE = 200


def _client_events(turns: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    event = lambda kind, text=none, language=none, asks=F.array().cast("array<string>"): F.struct(F.lit(kind).alias("kind"), text.alias("text"), language.alias("language"), asks.alias("follow_ups"))
    text, k = F.col("text"), F.col("conv_id") + F.col("turn")
    pieces = F.transform(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), lambda x: event("response_chunk", x))
    payload = F.when(k % 3 > 0, F.array(event("answer_payload", F.concat(F.lit("# "), F.left(text, F.lit(50))), none, F.slice(F.split("text", r"\.", -1), 1, (k % 3).cast("int"))), event("show_followups")))
    payload = F.coalesce(payload, F.array(event("other")))
    answer = F.concat(F.array(event("response_start")), pieces, F.when(k % 7 == 0, F.array(event("interrupted"))).otherwise(payload), F.array(event("done")))
    system = F.when(F.col("conv_id") % 5 == 0, F.array(event("reset"))).otherwise(F.array(event("set_answer_language", none, F.lit("ru"))))
    events = F.when(F.col("role") == "user", F.array(event("user_message", text, L.detect_language(text)))).when(F.col("role") == "assistant", answer).otherwise(system)
    rows = turns.select("conv_id", "turn", F.posexplode(events).alias("k", "e"))
    ts = F.timestamp_micros(F.lit(1_700_000_000_000_000) + (F.col("conv_id") * 60 + F.col("turn")) * 1_000_000 + F.col("k") * 1000)
    return rows.select("conv_id", (F.col("turn") * 10_000 + F.col("k")).alias("seq"), "e.*", ts.alias("ts"))


def shown_messages(x) -> F.Column:
    return F.array_join(F.transform(x, lambda m: F.concat_ws(":", m["id"].cast("string"), m["role"], m["text"])), "¦")


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = folds.in_order(_client_events(table(spark, sf_dir, "conversations")), ["conv_id"], ["seq"], dialogue.Conversation())
    return states.withColumn("messages", shown_messages(F.col("messages"))).withColumn("follow_ups", F.array_join("follow_ups", "¦"))


QUERIES["conversation_state"] = _conversations
ORACLES["conversation_state"] = f"""WITH RECURSIVE c AS (SELECT *, conv_id + turn AS k, {language('text')} AS lang, len(regexp_extract_all(text, '(?s).{{1,{PIECE}}}')) AS n FROM conversations),
  -- A turn of an assistant is applied whole: what its events come to.
  t AS (SELECT conv_id, turn, role, text, lang, k, turn * 10000 AS seq, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n,
    k % 7 = 0 AS broken, k % 7 <> 0 AND k % 3 > 0 AS paid, concat('# ', left(text, 50)) AS whole, string_split(text, '.')[1:k % 3] AS asks FROM c),
  s AS (SELECT DISTINCT conv_id, 0::BIGINT AS n, []::VARCHAR[] AS m, false AS note, []::VARCHAR[] AS f, false AS shown, 'en' AS language, false AS paid FROM c
    UNION ALL SELECT s.conv_id, t.n,
      CASE WHEN t.role = 'user' THEN list_append(s.m, concat(t.seq, ':user:', t.text))
           WHEN t.role = 'assistant' THEN list_append(s.m, concat(t.seq, ':avatar:', CASE WHEN t.paid THEN t.whole WHEN t.broken THEN t.text ELSE trim(t.text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) END))
           WHEN t.conv_id % 5 = 0 THEN [] ELSE s.m END,
      CASE WHEN t.role = 'user' THEN true WHEN t.role = 'assistant' OR t.conv_id % 5 = 0 THEN false ELSE s.note END,
      CASE WHEN t.role = 'assistant' THEN CASE WHEN t.paid THEN t.asks ELSE [] END WHEN t.role = 'system' AND t.conv_id % 5 = 0 THEN [] ELSE s.f END,
      CASE WHEN t.role = 'assistant' THEN t.paid WHEN t.role = 'system' AND t.conv_id % 5 = 0 THEN false ELSE s.shown END,
      CASE WHEN t.role = 'user' THEN t.lang WHEN t.role = 'system' THEN CASE WHEN t.conv_id % 5 = 0 THEN 'en' ELSE 'ru' END ELSE s.language END,
      CASE WHEN t.role = 'assistant' THEN t.paid WHEN t.role = 'system' AND t.conv_id % 5 = 0 THEN false ELSE s.paid END
    FROM s JOIN t ON t.conv_id = s.conv_id AND t.n = s.n + 1)
  SELECT conv_id, array_to_string(CASE WHEN note THEN list_append(m, '-1:avatar:__typing__') ELSE m END, '¦') AS messages, NULL::BIGINT AS active, array_to_string(f, '¦') AS follow_ups,
    shown AS follow_ups_shown, language, '' AS buffer, paid AS payload_received FROM s QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1"""

# The answer race: signups are questions, other events arrivals, by the group's time read 600 times as fast, so that the
# budgets of a quarter of a second and 12 seconds stand for two and a half minutes and two hours.
FAST = 600.0
_SOURCE = {"view": "faq", "click": "cache", "purchase": "local", "error": "generated"}


def _race(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _group_events(spark, sf_dir).withColumn("at", F.col("at") / FAST).withColumn("k", F.floor("value"))
    questions = e.filter("event_type = 'signup'").select(F.col("event_id").alias("id"), "session", "at", (F.col("k") % 5 == 0).alias("internal"))
    source = F.when(F.col("k") % 5 == 4, "external")
    for kind, name in _SOURCE.items():
        source = source.when(F.col("event_type") == kind, name)
    arrivals = e.filter("event_type <> 'signup'").select("session", source.alias("source"), "at", (F.col("k") % 3 > 0).alias("answered"), F.when(F.col("value") > 50, "high").otherwise("partial").alias("confidence"))
    return race.answer_race(questions, arrivals).withColumn("after", F.round("after", 5))


def _race_sql() -> str:
    b = race.Budgets()
    one = lambda s, x: f"max({x}) FILTER (WHERE source = '{s}')"
    columns = ", ".join(f"{one(s, 'after')} AS {s}_t, coalesce({one(s, 'answered::INT')} = 1, false) AS {s}_a, {one(s, 'confidence')} AS {s}_c" for s in race.SOURCES)
    kinds = " ".join(f"WHEN event_type = '{k}' THEN '{s}'" for k, s in _SOURCE.items())
    inf = "'infinity'::DOUBLE"
    return f"""WITH e AS (SELECT event_id, user_id % {GROUPS} AS session, epoch_us(ts) / 1e6 / {FAST} AS tm, event_type, floor(value)::BIGINT AS k, value FROM events),
  q AS (SELECT event_id AS id, session, tm AS asked, k % 5 = 0 AS internal FROM e WHERE event_type = 'signup'),
  a AS (SELECT session, CASE WHEN k % 5 = 4 THEN 'external' {kinds} END AS source, tm, k % 3 > 0 AS answered, CASE WHEN value > 50 THEN 'high' ELSE 'partial' END AS confidence FROM e WHERE event_type <> 'signup'),
  m AS (SELECT id, source, tm - asked AS after, answered, confidence FROM q JOIN a ON a.session = q.session AND tm >= asked AND tm - asked <= {b.most}
    QUALIFY row_number() OVER (PARTITION BY id, source ORDER BY tm - asked, NOT answered, confidence) = 1),
  p AS (SELECT id, {columns} FROM m GROUP BY id),
  w AS (SELECT q.id, internal, p.* EXCLUDE (id), greatest(coalesce(faq_t, {inf}), coalesce(cache_t, {inf})) AS quiet FROM q LEFT JOIN p USING (id)),
  f AS (SELECT *, least(quiet, {b.first}) AS stage, CASE WHEN faq_a AND faq_t <= {b.first} THEN faq_t ELSE {inf} END AS f_t, CASE WHEN cache_a AND cache_t <= {b.first} THEN cache_t ELSE {inf} END AS c_t,
    CASE WHEN generated_a AND generated_t <= {b.first} AND generated_t < quiet THEN generated_t ELSE {inf} END AS g_t FROM w),
  r AS (SELECT *, least(f_t, c_t, g_t) AS x, least(greatest(stage, coalesce(local_t, {inf})), {b.most}) AS l_done FROM f),
  z AS (SELECT *, CASE WHEN internal THEN CASE WHEN external_a AND external_t <= {b.external} THEN 'external' ELSE 'fallback' END
      WHEN isfinite(x) THEN CASE WHEN c_t = x THEN 'cache' WHEN f_t = x THEN 'faq' ELSE 'generated' END
      WHEN local_a THEN 'local' WHEN generated_a THEN 'generated' ELSE 'fallback' END AS winner FROM r)
  SELECT id, winner, round(CASE WHEN internal THEN least(coalesce(external_t, {inf}), {b.external}) WHEN isfinite(x) THEN x WHEN winner = 'local' THEN greatest(stage, local_t)
      WHEN winner = 'generated' THEN greatest(l_done, generated_t) ELSE least(greatest(l_done, coalesce(generated_t, {inf})), {b.most}) END, 5) AS after,
    CASE winner {" ".join(f"WHEN '{s}' THEN {s}_c" for s in race.SOURCES)} END AS confidence FROM z"""


QUERIES["race_first_answer"] = _race
ORACLES["race_first_answer"] = _race_sql()

"""Folds over sessions, in batches and streams, against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from textloom.operators import cache, dialogue, folds, gating, race, voice
from textloom.sources import shared
from textloom.plans import session_queries
from textloom.streaming import folded


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# The answer cache.

ASKED = "server bigint, id bigint, at double, language string, tokens array<string>"


def questions(rng, n):
    words = [f"w{k}" for k in range(14)]
    out, at = [], 0.0
    for i in range(n):
        at += rng.choice([0.0, 1.0, 30.0, 400.0])
        tokens = rng.sample(words, rng.choice([0, 1, 2, 10, 11, 12]))
        out.append((i % 2, i, at, rng.choice(["en", "ru"]), sorted(tokens)))
    return out


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def brute_cache(rows, ttl, most, win):
    entries, out = [], []
    for _, i, at, lang, tokens in rows:
        entries = [e for e in entries if at - e[1] <= ttl]
        scores = [jaccard(set(tokens), set(e[3])) for e in entries]
        best, hit = max(scores, default=0.0), None
        if best > 0:
            entries.append(entries.pop(scores.index(best)))
            hit = entries[-1][0] if best >= win and entries[-1][2] == lang else None
        if hit is None:
            entries = [*entries, (i, at, lang, tokens)][-most:]
        out.append((i, hit, best, len(entries)))
    return out


@pytest.mark.parametrize("most", [3, 256])
def test_cache_expires_and_evicts(spark, most):
    rows = questions(random.Random(most), 400)
    got = folds.in_order(spark.createDataFrame(rows, ASKED), ["server"], ["at", "id"], cache.AnswerCache(1800.0, most))
    want = [(s, *x) for s in (0, 1) for x in brute_cache([r for r in rows if r[0] == s], 1800.0, most, 0.9)]
    assert rows_of(got) == sorted(want, key=repr)
    assert any(h is not None for _, _, h, _, _ in want)


def test_alive_matches(spark):
    rows = questions(random.Random(8), 500)
    rows += [(0, 1000 + k, 100_000.0 + k, "en", ["hot", "words"]) for k in range(300)]  # one set of a third of the rows
    df = spark.createDataFrame(rows, ASKED)
    want = []
    for _, i, at, lang, t in rows:
        found = [(-jaccard(set(t), set(u)), b, j) for _, j, b, m, u in rows if m == lang and b < at and at - b <= 200.0]
        found = [x for x in found if -x[0] >= 0.9]
        if found:
            s, _, j = min(found)
            want.append((i, j, -s))
    assert rows_of(cache.alive_matches(df, df, ttl_s=200.0)) == sorted(want, key=repr)


# Voice chunks.


def brute_cut(text, number, p):
    """The rules read off each prefix of the text (which begins with no white space), with patterns."""
    letters = voice.LETTERS.pattern
    word = re.compile(f"{letters}+(?:['’\\-]{letters}+)?")
    least = p.first if number == 0 else p.least
    for n in range(1, len(text) + 1):
        t, found = text[:n], []
        c, filled = t[-1], len(t.rstrip())
        # Words of the prefix that what is read proves to be over: not at its end, nor before a joiner at its end.
        whole = [m.end() for m in word.finditer(t) if m.end() < n and not (m.end() == n - 1 and c in "'’-" and not re.search("['’-]", m.group()))]
        if c == "\n" and len(t.strip()) >= p.short:
            found.append(n)
        elif n > 1 and t[-2] in ".!?。！？" and n - 1 >= p.short and (c.isspace() or voice.CAPITALS.match(c)):
            found.append(n if c.isspace() else n - 1)
        if filled >= least:
            if voice.HAN.search(t):
                found.append(min(n, max(1, least)))
            else:
                found += [e for e in whole if e >= least][:1]
        if len(whole) >= 18 and not c.isspace():
            found.append(n if c in ".!?。！？" else whole[17])
        if filled > p.most:
            inside = [e for e in whole if e <= p.most]
            found.append(p.most if voice.HAN.search(t) or not inside else inside[-1])
        if found:
            return min(found)
    return None


def brute_chunks(text, p):
    out = []
    while True:
        text = text.lstrip()
        cut = brute_cut(text, len(out), p)
        chunk = voice.cleaned(text if cut is None else text[:cut])
        if chunk:
            out.append((len(out), chunk))
        if cut is None:
            return out
        text = text[cut:]


def spoken_texts():
    rng = random.Random(2)
    words = ["word", "low-latency", "a", "I'm", "3.5", "Өте", "конец", "stop.", "Go!", "what?", "wait -", "x-y-z", "\n", "fin .", "a" * 30, "it’s", "\t", "。"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(120))) for _ in range(60)]
    texts += ["".join(rng.choice("的一是不了人我在有他。！ a") for _ in range(200)) for _ in range(10)]
    return [*texts, "", "...", "x" * 600, "One.Two.Three", " ".join(["w"] * 17) + " last  . Next", " ".join(["w"] * 18) + "   ", "mixed 的 " * 40]


def fed(text, language, cuts):
    chunker = voice.VoiceChunks()
    state, out = chunker.start(), []
    for k, delta in enumerate(cuts):
        state, found = chunker.step(state, {"delta": delta, "language": language, "last": k == len(cuts) - 1})
        out += found
    return out


@pytest.mark.parametrize("language, profile", [("en", voice.WORD_PROFILE), ("zh", voice.HAN_PROFILE)])
def test_voice_chunks_hang_on_the_text_alone(language, profile):
    rng = random.Random(3)
    for text in spoken_texts():
        want = brute_chunks(text, profile)
        assert fed(text, language, [text]) == want
        assert fed(text, language, [*text, ""]) == want
        places = sorted(rng.choices(range(len(text) + 1), k=5))
        assert fed(text, language, [text[a:b] for a, b in zip([0, *places], [*places, len(text)], strict=True)]) == want
        assert "".join(c for _, c in want).replace(" ", "") == "".join(c for c in re.sub(r"\s", "", text)) or not want or language


def test_streamed_chunks_equal_those_at_once(spark, tmp_path):
    texts = spoken_texts()[:20]
    deltas = [(i, k, t[k * 9 : k * 9 + 9], "en", k * 9 >= len(t), k) for i, t in enumerate(texts) for k in range(len(t) // 9 + 2)]
    schema = "id int, seq int, delta string, language string, last boolean, s int"
    for part in (0, 1):  # the second half of each text comes in another batch
        rows = [d for d in deltas if (d[1] * 9 >= len(texts[d[0]]) // 2) == bool(part)]
        spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.col("s") + 1_000_000)).drop("s").coalesce(1).write.mode("append").parquet(str(tmp_path / "deltas"))
    made = lambda d: folded.in_order(d, ["id"], ["seq"], voice.VoiceChunks())
    got = shared.bounded_stream(spark, str(tmp_path / "deltas"), made, maxFilesPerTrigger=1)
    assert rows_of(got) == sorted(((i, *x) for i, t in enumerate(texts) for x in brute_chunks(t, voice.WORD_PROFILE)), key=repr)


# Utterances and conversations.


def test_utterances_are_finalised_once():
    fold = dialogue.Utterances(valid=lambda t: t != "um")
    token = lambda text, final=True, confidence=None, language=None: {"kind": "token", "text": text, "is_final": final, "confidence": confidence, "language": language}
    rows = [
        token("Hel", False), token(" Hello", language="en"), token(" noise", True, 0.2), token(" there", True, 0.5), token("<end>", False), token(" <end> "),
        token("hello"), token("  THERE"), token("<end>"), token("more"), token("<fin>"), token("and more"), token("<end>"), token("um"), token("<end>"), token("<end>"), token(""),
        {"kind": "reset"}, token("Hello there"), token("<fin>"), token("again", language="ru"), token("<end>"), token("once"), token("<end>"),
    ]
    state, out = fold.start(), []
    for r in rows:
        state, found = fold.step(state, r)
        out += found
    assert out == [
        ("Hello there", "en", "<end>", True, True), ("hello  THERE", "en", "<end>", False, False), ("more", "en", "<fin>", True, False), ("and more", "en", "<end>", True, False),
        ("Hello there", "en", "<fin>", True, False), ("again", "ru", "<end>", True, True), ("once", "ru", "<end>", True, False),
    ]


CLIENT = "conv bigint, seq bigint, kind string, text string, language string, follow_ups array<string>, s int"


def client_rows():
    rng = random.Random(6)
    kinds = ["user_message", "response_start", "response_chunk", "response_chunk", "answer_payload", "done", "interrupted", "reset", "set_answer_language", "show_followups", "other"]
    return [(c, k, rng.choice(kinds), rng.choice([None, "", " some ", "text"]), rng.choice([None, "kk"]), rng.choice([None, [], ["Why?"]]), k) for c in range(30) for k in range(rng.randrange(1, 40))]


def test_conversation_rules():
    fold = dialogue.Conversation()

    def after(*events):
        state = fold.start()
        for k, e in enumerate(events):
            kind, text, *rest = (*e, None, None) if isinstance(e, tuple) else (e, None)
            state, _ = fold.step(state, {"seq": k, "kind": kind, "text": text, "language": "ru" if rest and rest[0] else None, "follow_ups": ["Why?"]})
        return state

    shown = lambda s: [(m["role"], m["text"]) for m in s["messages"]]
    assert shown(after(("user_message", "hi"))) == [("user", "hi"), ("avatar", "__typing__")]
    assert shown(after(("user_message", "hi"), "response_start", ("response_chunk", " a"), ("response_chunk", "b "))) == [("user", "hi"), ("avatar", " ab ")]
    assert shown(after("response_start", ("response_chunk", " ab "), "done")) == [("avatar", "ab")]
    s = after("response_start", ("response_chunk", " ab "), ("answer_payload", "whole"), "show_followups", "done")
    assert shown(s) == [("avatar", "whole")] and s["shown"] and s["active"] is None and s["buffer"] == ""
    assert shown(after(("response_chunk", "late"), "interrupted", ("response_chunk", "new"))) == [("avatar", "late"), ("avatar", "new")]
    assert after(("user_message", "x"), "reset") == fold.start()


def test_streamed_conversations_end_by_timer(spark, tmp_path):
    """Batch and stream give the same final states; a stream's come when event time has gone on."""
    rows = client_rows()
    batch = folds.in_order(spark.createDataFrame(rows, CLIENT), ["conv"], ["seq"], dialogue.Conversation())
    later = [(-1, 0, "other", None, None, None, 100_000), (-2, 0, "other", None, None, None, 200_000)]
    for part in ([r for r in rows if r[1] < 15], [r for r in rows if r[1] >= 15], *([x] for x in later)):
        spark.createDataFrame(part, CLIENT).withColumn("ts", F.timestamp_seconds(F.col("s") + 1_000_000)).drop("s").coalesce(1).write.mode("append").parquet(str(tmp_path / "client"))
    made = lambda d: folded.in_order(d, ["conv"], ["seq"], dialogue.Conversation(), late="1 hour")
    got = shared.bounded_stream(spark, str(tmp_path / "client"), made, maxFilesPerTrigger=1)
    assert rows_of(got.filter("conv >= 0")) == rows_of(batch)


# Interrupts and turns.


def brute_gate(events, cooldown):
    out, last, shut = [], {}, {}
    for s, at, seq, kind in sorted(events):
        if kind == "open":
            shut[s] = False
        elif kind == "try" and not shut.get(s) and (s not in last or at - last[s] >= cooldown):
            last[s], shut[s] = at, True
            out.append((s, seq))
    return sorted(out)


@pytest.mark.parametrize("piece_s", [0.7, 5.0, 1000.0])
def test_gate_in_pieces(spark, piece_s):
    rng = random.Random(5)
    users = [0] * 1000 + [rng.randrange(1, 40) for _ in range(2000)]  # one user holds a third of the rows
    events = [(u, round(rng.uniform(-20, 60), 1), k, rng.choice(["open", "try", "try", "other"])) for k, u in enumerate(users)]
    df = spark.createDataFrame(events, "session bigint, at double, seq bigint, kind string")
    got = gating.gated(df, "session", "at", ["at", "seq"], F.col("kind") == "try", F.col("kind") == "open", 1.0, piece_s)
    assert got.count() == 3000
    assert sorted((r["session"], r["seq"]) for r in got.filter("passed").collect()) == brute_gate(events, 1.0)


def test_gate_of_long_cooldowns_and_nothing(spark):
    events = [(1, float(k), k, "try" if k % 3 else "open") for k in range(400)]
    df = spark.createDataFrame(events, "session bigint, at double, seq bigint, kind string")
    got = gating.gated(df, "session", "at", ["at", "seq"], F.col("kind") == "try", F.col("kind") == "open", 25.0, 10.0)
    assert sorted((r["session"], r["seq"]) for r in got.filter("passed").collect()) == brute_gate(events, 25.0)
    assert gating.gated(df.limit(0), "session", "at", ["at", "seq"], F.lit(True), F.lit(True), 1.0).collect() == []


@pytest.mark.parametrize("piece_s", [0.5, 7.0, 1000.0])
def test_active_turns(spark, piece_s):
    rng = random.Random(9)
    events, want = [], []
    for k in range(900):
        u = 0 if k % 3 == 0 else rng.randrange(20)
        events.append((u, round(rng.uniform(0, 50), 1), k, rng.choice(["start", "end", "event", "event"]), rng.choice([None, *range(4)])))
    active = {}
    for u, _, k, kind, turn in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        if kind == "start":
            active[u] = turn
        elif kind == "end" and (turn is None or turn == active.get(u)):
            active[u] = None
        now = active.get(u)
        want.append((k, now, kind in ("start", "end") or turn is None or now is None or turn == now))
    df = spark.createDataFrame(events, "session bigint, at double, seq bigint, kind string, turn bigint")
    got = gating.active_turns(df.filter("kind <> 'start' OR turn IS NOT NULL"), piece_s=piece_s).select("seq", "active", "kept")
    named = {e[2] for e in events if not (e[3] == "start" and e[4] is None)}
    if len(named) < len(events):  # starts without a turn are not part of the rule
        active, want = {}, []
        for u, _, k, kind, turn in sorted((e for e in events if e[2] in named), key=lambda e: (e[0], e[1], e[2])):
            if kind == "start":
                active[u] = turn
            elif kind == "end" and (turn is None or turn == active.get(u)):
                active[u] = None
            now = active.get(u)
            want.append((k, now, kind in ("start", "end") or turn is None or now is None or turn == now))
    assert rows_of(got) == sorted(want, key=repr)


# The answer race.


def brute_race(question, arrivals, b):
    """Arrivals played one after the other."""
    first = {}
    for source, after, answered, confidence in sorted(arrivals, key=lambda x: (x[1], not x[2], x[3])):
        if 0 <= after <= max(b.most, b.external):
            first.setdefault(source, (after, answered, confidence))
    came = lambda s, most: first.get(s) if s in first and first[s][0] <= most else None
    if question["internal"]:
        x = came("external", b.external)
        return ("external", x[0], x[2]) if x and x[1] else ("fallback", x[0] if x else b.external, None)
    waiting, now = {"faq", "cache", "generated"}, 0.0
    for after, source in sorted((first[s][0], s) for s in waiting if came(s, b.first)):
        if waiting == {"generated"}:
            break
        now = after
        waiting.discard(source)
        if first[source][1]:
            return source, after, first[source][2]
    now = now if waiting == {"generated"} else b.first
    x = came("local", b.most)
    if x and x[1]:
        return "local", max(now, x[0]), x[2]
    now = max(now, x[0]) if x else b.most
    x = came("generated", b.most)
    if x and x[1]:
        return "generated", max(now, x[0]), x[2]
    return "fallback", max(now, x[0]) if x else b.most, None


def test_answer_race(spark):
    rng, b = random.Random(11), race.Budgets()
    asked, came, want = [], [], []
    for i in range(600):
        at = i * 100.0
        q = (i, i % 7, at, rng.random() < 0.2)
        mine = [(s, rng.choice([0.0, 0.1, 0.25, 0.26, 5.0, 8.0, 12.0, 12.5, 20.0]) , rng.random() < 0.6, rng.choice(["high", "low"])) for s in race.SOURCES for _ in range(rng.choice([0, 1, 1, 2]))]
        # Two at the very same moment have no order; leave them out.
        mine = list({(x[1]): x for x in mine}.values())
        asked.append(q)
        came += [(i % 7, s, at + a, ok, c) for s, a, ok, c in mine]
        want.append((i, *brute_race({"internal": q[3]}, [(s, at + a - at, ok, c) for s, a, ok, c in mine], b)))
    questions = spark.createDataFrame(asked, "id bigint, session bigint, at double, internal boolean")
    arrivals = spark.createDataFrame(came, "session bigint, source string, at double, answered boolean, confidence string")
    got = [(i, w, round(a, 6), c) for i, w, a, c in map(tuple, race.answer_race(questions, arrivals).collect())]
    assert sorted(got) == sorted((i, w, round(a, 6), c) for i, w, a, c in want)
    assert {w for _, w, _, _ in got} == {*race.SOURCES, "fallback"}


@pytest.mark.parametrize("rows", [session_queries._deltas, session_queries._spoken])
def test_language_is_told_once_a_text(spark, rows):
    turns = spark.createDataFrame([(1, 1, "assistant", "some text of it")], "conv_id bigint, turn bigint, role string, text string")
    above = rows(turns)._jdf.queryExecution().optimizedPlan().toString().partition("Generate")[0]
    assert "Project" in above and not re.search(r"regexp|RLIKE|lower\(|CASE", above)


def test_streamed_groups_equal_keys_by_themselves(spark, tmp_path):
    """States of a group are kept apart, over batches, and end each at its own time."""
    rows = client_rows()
    batch = folds.in_order(spark.createDataFrame(rows, CLIENT), ["conv"], ["seq"], dialogue.Conversation())
    later = [(-1, 0, "other", None, None, None, 1_500), (-1, 1, "other", None, None, None, 100_000), (-40, 0, "other", None, None, None, 200_000)]
    for part in ([r for r in rows if r[1] < 15], [r for r in rows if r[1] >= 15], *([x] for x in later)):
        spark.createDataFrame(part, CLIENT).withColumn("ts", F.timestamp_seconds(F.col("s") + 1_000_000)).drop("s").coalesce(1).write.mode("append").parquet(str(tmp_path / "client"))
    made = lambda d: folded.in_order(d, ["conv"], ["seq"], dialogue.Conversation(), late="1 hour", group="conv div 7")
    got = shared.bounded_stream(spark, str(tmp_path / "client"), made, maxFilesPerTrigger=1)
    assert rows_of(got.filter("conv >= 0")) == rows_of(batch)


def test_crowded_race_makes_no_pairs(spark):
    """Thousands of questions and arrivals of one moment: none is joined with another, and the first ones are found."""
    n = 3000
    questions = spark.range(n).selectExpr("id", "'s' AS session", "id / 1000D AS at", "false AS internal")
    arrivals = spark.range(n).selectExpr("'s' AS session", "IF(id % 2 = 0, 'faq', 'local') AS source", "12.5D + id / 1000 AS at", "id % 3 > 0 AS answered", "'high' AS confidence")
    found = race.first_arrivals(questions, arrivals, 12.0)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r["id"]: r["first"] for r in found.collect()}
    assert set(got) == set(range(n))
    for i, first in got.items():
        # Questions before 0.5 are too early for the first arrivals at 12.5 and 12.501.
        want = {s: round(12.5 + max(k, k + -(-(i - 12500 - k) // 2) * 2) / 1000 - i / 1000, 6) for s, k in (("faq", 0), ("local", 1))}
        assert {s: round(x["after"], 6) for s, x in first.items()} == {s: x for s, x in want.items() if x <= 12}

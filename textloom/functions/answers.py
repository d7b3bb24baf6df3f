"""Answers put together from a text and its sources: points, details and whether a turn is complete."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import language as L
from . import payload as P
from . import spoken as S
from . import text as T

MOST_POINTS, MOST_SOURCES, MOST_SENTENCES, LEAST_WORDS, MOST_WORDS = 3, 4, 4, 5, 34
#: Terms of the subject and of requests, which a caller can replace by their own.
SUBJECT_TERMS = (
    "fintech", "expat", "centre", "center", "экспат", "центр", "орталық", "орталығы", "сот", "арбитраж", "тіркеу", "реттеу", "құжат", "құжаттар",
    "注册", "监管", "法院", "仲裁", "金融科技",
)
REQUEST_TERMS = (
    "about", "tell", "explain", "information", "describe", "show", "help", "о", "об", "про", "расскажите", "объясните", "информация", "помогите",
    "туралы", "жөнінде", "жайлы", "айтып", "айтыңыз", "беріңіз", "түсіндіріңіз", "ақпарат", "көмектесіңіз", "关于", "告诉", "解释", "介绍", "信息", "帮助",
)
SECTIONS_TYPE = "array<struct<title:string,text:string,items:array<string>>>"
DETAILS_TYPE = f"struct<summary:string,points:array<string>,sections:{SECTIONS_TYPE},answer_kind:string,confidence:string>"


def short_point(sentence: Column) -> Column:
    """A sentence as a point; empty where it holds placeholders, is a long enumeration, or ends on a link word."""
    def choose(c: Column) -> Column:
        over = F.size(F.split(c, r"\s+")) > MOST_WORDS
        bad = c.rlike(r"(?i)\b(?:undefined|nan|null)\b") | (over & (F.regexp_count(c, F.lit(";")) >= 3))
        cut = T.squeezed(F.regexp_replace(S.capped(c, MOST_WORDS), r"\s+for\s+\d+\.?$", "."))
        return F.when(bad, "").otherwise(T.let(cut, lambda x: F.when(x.rlike(r"(?i)\b(?:and|or|for|of|with|to|in)\.?$"), "").otherwise(x)))

    return T.let(S.sanitized(sentence, keep_digits=True), choose)


def point_key(x: Column) -> Column:
    return T.trimmed(F.regexp_replace(F.lower(x), L.NOT_WORD, " "))


def points(spoken: Column, bodies: Column) -> Column:
    """Up to three points from the first sources (texts of chunks) that neither hold nor are held by the spoken answer or
    by a point before. With nothing spoken there are none, as every text holds the empty one."""
    sentences = F.flatten(F.transform(F.slice(bodies, 1, MOST_SOURCES), lambda b: F.slice(T.sentences(S.answer_body(b)), 1, MOST_SENTENCES)))
    keyed = F.transform(F.transform(sentences, short_point), lambda p: F.struct(p.alias("p"), point_key(p).alias("k")))
    fit = F.filter(keyed, lambda x: (F.size(F.split(x["p"], r"\s+")) >= LEAST_WORDS) & (x["k"] != ""))
    start = F.struct(F.array(point_key(spoken)).alias("seen"), F.array().cast("array<string>").alias("points"))

    def step(acc: Column, x: Column) -> Column:
        taken = F.exists(acc["seen"], lambda s: s.contains(x["k"]) | x["k"].contains(s)) | (F.size(acc["points"]) >= MOST_POINTS)
        return F.when(taken, acc).otherwise(F.struct(F.array_append(acc["seen"], x["k"]).alias("seen"), F.array_append(acc["points"], x["p"]).alias("points")))

    return F.aggregate(fit, start, step, lambda acc: acc["points"])


def candidate(answer: Column, bodies: Column) -> Column:
    """An answer in tags: two sentences or forty words to be spoken, then the whole of it with its points."""
    whole = S.sanitized(answer, keep_digits=True)
    said = S.capped(F.array_join(F.slice(T.sentences(whole), 1, 2), " "), 40)
    more = T.let(points(whole, bodies), lambda p: F.when(F.size(p) > 0, F.concat(F.lit("\n\n## Relevant details\n- "), F.array_join(p, "\n- "))).otherwise(""))
    return P.wrap_tags(said, F.concat(whole, more))


def enforced(details: Column) -> Column:
    """Details (JSON) as summary, points, kind and confidence: the summary is else the first section's text or item, the
    points are else the sections' items and texts, or the summary."""
    clean = lambda x: T.trimmed(F.coalesce(x, F.lit("")))
    some = lambda a: F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), T.trimmed), lambda x: x != "")

    def made(d: Column) -> Column:
        sections = F.coalesce(d["sections"], F.array().cast(SECTIONS_TYPE))
        firsts = F.transform(sections, lambda s: F.when(clean(s["text"]) != "", clean(s["text"])).otherwise(clean(F.get(s["items"], F.lit(0)))))
        summary = F.when(clean(d["summary"]) != "", clean(d["summary"])).otherwise(F.coalesce(F.get(F.filter(firsts, lambda x: x != ""), F.lit(0)), F.lit("")))
        listed = F.flatten(F.transform(sections, lambda s: F.concat(some(s["items"]), F.filter(F.array(clean(s["text"])), lambda x: x != ""))))
        own = F.when(F.size(some(d["points"])) > 0, some(d["points"])).when(F.size(listed) > 0, listed).otherwise(F.filter(F.array(summary), lambda x: x != ""))
        sure = T.let(clean(d["confidence"]).try_cast("double"), lambda c: F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))).otherwise(P.DEFAULT))
        return F.struct(summary.alias("summary"), own.alias("points"), P.enum_guard(F.coalesce(d["answer_kind"], F.lit("direct"))).alias("answer_kind"), sure.alias("confidence"))

    return T.let(F.from_json(details, DETAILS_TYPE), made)


def is_final_turn(plain: Column, signature: Column, smalltalk: Column, require_signal: bool, subject: tuple[str, ...] = SUBJECT_TERMS) -> Column:
    """Whether a turn is complete: a stop command, small talk or a new query, else words on the subject or a request, else
    (unless a signal is required) enough of them. plain: lower case, single blanks; signature: without punctuation."""
    n, han = F.regexp_count(plain, F.lit(r"\p{L}+")), F.regexp_count(plain, F.lit(f"[{L.HAN}]"))
    at_once = smalltalk | L.is_new_query(signature)
    on_subject = L.contains_any(plain, subject) & ((n > 0) | (han >= 2))
    asks = L.contains_any(plain, REQUEST_TERMS) & ((n >= 2) | (han >= 3))
    enough = F.lit(not require_signal) & ((han >= 4) | ((n >= 3) & (F.regexp_count(plain, F.lit(r"\p{L}")) >= 12)))
    return (plain != "") & L.is_speech(plain, at_once, on_subject | asks | enough)

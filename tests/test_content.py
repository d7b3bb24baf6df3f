"""Payloads, page documents, text vectors, speech and structured files on small tables, against brute force."""

import json
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import speech as S
from textloom.functions import text as T
from textloom.operators import chunks, paged, text_vectors, vectors
from textloom.operators import payloads as P
from textloom.sources import jsonl

# Payloads.


def string_field(v):
    if isinstance(v, str):
        return v.strip()
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return str(v)
    return next((t for k in P.TEXT_KEYS if (t := string_field(v.get(k)))), "") if isinstance(v, dict) else ""


def answer_text(v):
    if isinstance(v, str):
        return v.strip()
    if not isinstance(v, dict):
        return ""
    if found := string_field({k: v.get(k) for k in P.TEXT_KEYS}):
        return found
    if found := next((t for k in P.NESTED if (t := answer_text(v.get(k)))), ""):
        return found
    first = (v.get("choices") or [None])[0] if isinstance(v.get("choices"), list) else None
    return answer_text(first.get("message") or first) if isinstance(first, dict) else ""


def random_value(rng, depth):
    keys = [*P.TEXT_KEYS, *P.NESTED, "choices", "other"]
    if depth == 0 or rng.random() < 0.25:
        return rng.choice(["", " ", " text ", "x", 3, 0, 2.5, True, None, [], {}])
    if rng.random() < 0.15:
        return [random_value(rng, depth - 1) for _ in range(rng.randrange(3))]
    return {k: random_value(rng, depth - 1) for k in rng.sample(keys, rng.randrange(1, 5))}


def payloads(spark, values):
    return spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "id bigint, b string").select("id", F.parse_json("b").alias("v"))


def test_answers_at_any_depth(spark):
    rng = random.Random(4)
    values = [random_value(rng, 9) for _ in range(400)]
    deep = "end"
    for _ in range(12):
        deep = {"result": deep}
    values += [deep, {"choices": [{"message": {"choices": [{"message": {"content": {"text": {"summary": " far "}}}}]}}]}]
    got = {r["id"]: r["answer"] for r in P.normalised(payloads(spark, values)).collect()}
    assert got == {i: answer_text(v) for i, v in enumerate(values)}
    assert sum(map(bool, got.values())) > 100


def test_payload_fields(spark):
    values = [
        {"chunks": [], "docs": ["", " one ", {"body": {"text": "two"}, "title": "T", "rerank_score": "0.7"}, {"title": "none"}, 5, {"content": "three", "similarity": "bad"}], "answer": "A"},
        {"data": {"result": {"sources": "lone"}}, "confidence": "HIGH"}, {"citations": [{"name": {"text": "n"}}, "x", "x", {"url": ""}, 7, "y", "z"], "confidence": 0.12, "details": 1},
        {"source": "only", "score": "x", "similarity": "0.3"}, [], "text", None, {"confidence": True, "answer": "B"},
    ]
    got = {r["id"]: r for r in P.normalised(payloads(spark, values)).collect()}
    assert [tuple(x) for x in got[0]["chunks"]] == [("one", "external_rag"), ("two", "T"), ("three", None)] and got[0]["citations"] == ["external_rag", "T"]
    assert (got[0]["confidence"], got[0]["score"]) == ("high", 0.7)
    assert [tuple(x) for x in got[1]["chunks"]] == [("lone", "external_rag")] and got[1]["confidence"] == "high"
    assert got[2]["citations"] == ["n", "x", "7", "y"] and (got[2]["confidence"], got[2]["score"], got[2]["is_contract"]) == ("partial", 0.12, True)
    assert got[3]["citations"] == ["only"] and (got[3]["confidence"], got[3]["score"]) == ("high", 0.3)
    assert [(got[i]["answer"], got[i]["confidence"]) for i in (4, 5, 6)] == [("", "not_found"), ("text", "high"), ("", "not_found")]
    assert (got[7]["confidence"], got[7]["score"]) == ("high", 0.92)


# Page documents: the rules on lines are the library's own (held to SQL elsewhere); here it is what is done with them.


class Lines:
    def __init__(self, spark, lines):
        rows = spark.createDataFrame([(x,) for x in sorted(set(lines))], "x string")
        x = F.col("x")
        found = rows.select(
            "x", T.is_noise_line(x).alias("noise"), T.is_contents_line(x).alias("toc"), T.is_heading(x).alias("heading"), T.useful_word_count(x).alias("words"), T.line_key(x).alias("key"),
            T.clean_heading_line(x).alias("clean"),
        ).collect()
        self.of = {r["x"]: r for r in found}


def brute_pages(text, words):
    pages, current = [], []
    for line in map(str.strip, text.split("\n")):
        if re.match(r"^\[H2\]\s+Page\s+\d+", line, re.IGNORECASE):
            pages, current = pages + [current] * bool(current), []
        elif re.fullmatch(r"\d{1,3}", line):
            if current and sum(words(x) for x in current) > 20:
                pages, current = [*pages, current], []
        else:
            current.append(line)
    return pages + [current] * bool(current)


def brute_document(text, rules):
    cleaned = []
    for page in brute_pages(text, lambda x: rules(x)["words"]):
        lines = []
        for line in page:
            if re.search(r"\bTable of Contents\b", line, re.IGNORECASE):
                break
            if line and not rules(line)["noise"] and not rules(line)["toc"]:
                line = re.sub(r"\b([A-Za-z])-\s+([a-z]{2,})\b", r"\1\2", re.sub(r"^#{1,6}\s+", "", line).strip())
                lines += [re.sub(r"\s{2,}", " ", line)] * bool(line)
        merged = []
        for line in lines:
            if merged and merged[-1][1] and not line.startswith("|"):
                merged[-1] = (f"{merged[-1][0].rstrip('.')} {line}", False)
            else:
                merged.append((line, re.fullmatch(r"(?:\d+(?:\.\d+)+\.?|\([a-zA-Z]\))", line) is not None))
        lines = [x for x, _ in merged]
        heads = sum(rules(x)["heading"] for x in lines)
        if not lines or sum(rules(x)["words"] for x in lines) < 15 or (len(lines) >= 4 and heads / len(lines) > 0.8 and sum(bool(re.search(r"[.!?;:]$", x)) for x in lines) <= 1):
            continue
        lists = sum(rules(x)["toc"] or re.fullmatch(r"\d{1,3}", x) is not None for x in lines)
        if any(re.search(r"\bCONTENT\b", x, re.IGNORECASE) for x in lines) and lists + 3 >= len(lines) * 0.25:
            continue
        first = next((k for k, x in enumerate(lines) if re.match(r"^\d+\.\s+", x)), None)
        if first and first > 1:
            above = lines[first - 1]
            lines = [above] * (rules(above)["heading"] and not re.search(r"\d+\s*$", above)) + lines[first:]
        cleaned.append(chunks._repair(lines))
    edges = Counter(k for p in cleaned for x in [*p[:4], *p[-4:]] if 5 <= len(k := rules(x)["key"]) <= 90)
    gone = {k for k, c in edges.items() if c >= 3 and c >= max(2, len(cleaned) // 4)}
    out = []
    for k, page in enumerate(cleaned, 1):
        out += [""] * (k > 1) + [f"[H2] Page {k}"]
        for x in page:
            if rules(x)["key"] not in gone:
                c = rules(x)["clean"]
                sub = re.match(r"^\d+(?:\.\d+)*\.?\s+", c) and not re.match(r"^(PART|Schedule|Chapter)\s+\d+", c, re.IGNORECASE)
                out.append(("## " if sub else "# ") + c if rules(x)["heading"] and not x.startswith("|") else x)
    return ("\n".join(out).strip() or text.strip()) + "\n"


def page_texts():
    rng = random.Random(12)
    lines = [
        "GENERAL PROVISIONS", "PART 1 GENERAL RULES", "1.2 Scope of these rules", "1.2.", "(a)", "| a | b |", "Read more", "PART 2: FEES ......... 9", "words go on and on over the line",
        "and end here in the second one.", "1. First numbered clause of the whole document stands here.", "The quick brown fox jumps over the lazy dog every single day of the year.", "7", "42",
        "Table of Contents", "CONTENT of the book", "split- word here", "", "another line with enough words to stay on the page after all",
    ]
    texts = []
    for _ in range(40):
        body = []
        for p in range(rng.randrange(1, 9)):
            mark = [f"[H2] Page {p + 1}"] if rng.random() < 0.7 else [str(p)]
            body += [*mark, "Annual report of the office", *rng.choices(lines, k=rng.randrange(14)), "All rights stay with the author"]
        texts.append("\n".join(body))
    return [*texts, "", "7", "short", "[H2] Page 1"]


def test_page_documents(spark):
    texts = page_texts()
    seen = set()
    for t in texts:  # every line that a rule may be asked about: as it stands, cleaned, merged, joined
        for page in [*brute_pages(t, lambda x: 0), *brute_pages(t, lambda x: 99)]:
            seen |= set(page)
    known = Lines(spark, seen).of

    def rules(line):
        if line not in known:
            known.update(Lines(spark, [line]).of)
        return known[line]

    df = spark.createDataFrame(list(enumerate(texts)) + [(len(texts), None)], "doc_id bigint, text string")
    got = {r["id"]: r["text"] for r in paged.clean_documents(df).collect()}
    assert got == {i: brute_document(t, rules) for i, t in enumerate(texts)} | {len(texts): "\n"}
    split = paged.page_lines(df)
    counts = Counter(r["id"] for r in split.select("id", "page").distinct().collect())
    assert counts == Counter({i: n for i, t in enumerate(texts) if (n := len(brute_pages(re.sub("\n{4,}", "\n\n\n", t.strip()), lambda x: rules(x)["words"])))} | {len(texts): 1})


# Vectors and scores.


def test_top_k_in_blocks(spark):
    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=(300, 8)), 1)
    v[100:140] = v[7]  # ties
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [1.0])], "id bigint, vector array<double>").repartition(7)
    queries = rows.filter("id < 60")
    got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in vectors.top_k_blocks(queries, rows, 9, block=13).collect()}
    scores = np.round(v[:60] @ v.T, 9)
    want = {(q, k + 1): (int(i), float(scores[q, i])) for q in range(60) for k, i in enumerate(sorted(range(300), key=lambda i, q=q: (-scores[q, i], i))[:9])}
    assert got.keys() == want.keys() and all(got[x][0] == want[x][0] and math.isclose(got[x][1], want[x][1], abs_tol=1e-8) for x in want)
    assert vectors.top_k_blocks(queries.limit(0), rows, 9).collect() == []


def test_hashed_vectors_near_word_cosine(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(3000)]
    base = [rng.choices(vocabulary, k=80) for _ in range(40)]
    texts = [" ".join(w if rng.random() > 0.3 else rng.choice(vocabulary) for w in b) for b in base for _ in range(6)]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(999, None), (998, " ,. ")], "id bigint, text string")
    hashed = text_vectors.hashed_vectors(rows, "id", "text")
    assert hashed.count() == len(texts)
    found = {}
    for r in vectors.top_k_blocks(hashed.filter("id % 6 = 0"), hashed, 6).collect():
        found.setdefault(r["query_id"], set()).add(r["id"])
    counts = [Counter(t.split()) for t in texts]
    length = [math.sqrt(sum(x * x for x in c.values())) for c in counts]
    exact = {i: set(sorted(range(len(texts)), key=lambda j, i=i: -sum(n * counts[j][w] for w, n in counts[i].items()) / length[i] / length[j])[:6]) for i in range(0, len(texts), 6)}
    assert sum(len(found[i] & exact[i]) for i in exact) / (6 * len(exact)) >= 0.9


def test_reranked(spark):
    docs = spark.createDataFrame([(1, "the visa fee is high"), (2, "the the the"), (3, None), (4, "a visa"), (5, "other")], "id bigint, text string")
    queries = spark.createDataFrame([(10, "visa fee"), (11, "nothing known")], "id bigint, text string")
    hits = spark.createDataFrame([(q, i, k) for q in (10, 11) for k, i in enumerate((5, 3, 2, 4, 1), 1)], "query_id bigint, id bigint, rank bigint")
    got = {q: [r["id"] for r in text_vectors.reranked(hits, queries, docs, top=4).orderBy("rank").collect() if r["query_id"] == q] for q in (10, 11)}
    assert got == {10: [1, 4, 5, 3], 11: [5, 3, 2, 4]}


# Speech and files.


@pytest.mark.parametrize(
    "text, language, want",
    [
        ("one two three four five six seven eight, nine; ten", "en", "One two three four five six seven eight. Nine; ten"), ("short, clause: here", "en", "Short, clause: here"),
        ("no marks at all", "en", "no marks at all"), ("", "en", ""), (None, "en", ""), ("а б в г д е ж з, и", "ru", "А б в г д е ж з. И"), ("x" * 95 + ", y", "en", "X" + "x" * 94 + ". Y"),
        ("一二三，四", "zh", "一二三 四"),
    ],
)
def test_sentences_for_speech(spark, text, language, want):
    df = spark.createDataFrame([(text, language)], "x string, l string")
    assert df.select(S.sentenceized(F.col("x"), F.col("l"))).first()[0] == want


def test_prepared_text(spark):
    rows = [(" It is 5% at 12:30. It is 5% at 12:30. [laughs] Yes!! ", "en"), ("42", "xx"), (None, "en"), ("7 дней", "ru")]
    got = S.prepared(spark.createDataFrame(rows, "x string, l string"), "x", "l", "y").select("y", S.spaced_like(F.col("y"), F.col("x"))).collect()
    assert [r[0] for r in got] == ["It is five percent at twelve thirty. Yes!", "forty two", "", "семь дней"]
    assert got[0][1] == " It is five percent at twelve thirty. Yes! "


def test_rejected_lines(spark, tmp_path):
    good = {"url": " u ", "title": "T", "content": [{"type": "text", "text": "x"}], "faq_pairs": [{"question": "q", "answer": "a"}, {"question": "q", "answer": ""}]}
    lines = [json.dumps(good), "", "{broken", "[1]", '"text"', "{}", json.dumps(good)[:-3], "   "]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    (tmp_path / "b.jsonl").write_text(json.dumps({"content": "no list", "faq_pairs": 5}))
    rows, bad = jsonl.page_records(spark, str(tmp_path), "here")
    assert sorted((r["url"], r["title"], r["body"]) for r in rows.collect()) == [("", "", ""), ("", "", ""), ("u", "T", "x\nQ: q\nA: a")]
    assert sorted(r["line"] for r in bad.collect()) == sorted(["{broken", "[1]", '"text"', json.dumps(good)[:-3]])
    assert all(r["path"].endswith("a.jsonl") for r in bad.collect())

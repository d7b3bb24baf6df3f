"""What keeps operators within memory and time on larger tables, and that results stay the same."""

from __future__ import annotations

import hashlib
import math
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from textloom.functions import language as L
from textloom.functions import rows
from textloom.functions import text as T
from textloom.operators import chunkers, paged, pages, text_vectors, vectors
from textloom.plans import choice_queries


def test_rows_are_taken_a_few_megabytes_at_a_time(spark):
    a = pa.array(["x" * 3000] * 4000 + [None, "y" * 5_000_000])
    parts = list(rows.pieces(a))
    assert pa.concat_arrays(parts).equals(a)
    assert all(p.nbytes <= rows.AT_ONCE or len(p) == 1 for p in parts)
    t = spark.range(3000).select("id", F.when(F.col("id") % 7 > 0, F.repeat(F.col("id").cast("string"), 900)).alias("t"))
    kind = "t string, n int"
    out = t.select("id", "t", rows.each(F.col("t"), lambda x: {"t": x[:3], "n": len(x)}, spark.createDataFrame([], kind).schema).alias("x"))
    assert out.filter("NOT (x.t <=> left(t, 3)) OR NOT (x.n <=> length(t))").count() == 0


def test_texts_within_their_budget_skip_python(spark):
    docs = spark.createDataFrame([(1, "short"), (2, None), (3, "word. " * 2000), (4, "")], "doc_id int, text string")
    got = {r.doc_id: r.c for r in docs.select("doc_id", chunkers.parts_of(F.col("text"), 100).alias("c")).collect()}
    assert got[1] == ["short"] and got[2] is None and got[4] == [""] and len(got[3]) > 20
    assert docs.select(chunkers.parts_of(F.col("text"), 100, True).alias("c")).filter("c[0] = 'short'").count() == 1


def test_lines_of_a_document_meet_its_cuts_by_document_alone(spark):
    docs = spark.createDataFrame([(1, "[H2] Page 1\n" + "plain words here\n" * 9 + "7\nlast line")], "doc_id int, text string")
    out = paged.page_lines(docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "split(" not in plan
    assert [(r.page, r.line) for r in out.orderBy("n").collect()] == [(1, "plain words here")] * 9 + [(2, "last line")]


def test_block_files_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pages, "RECORDS", 3)
    e = F.lit("")
    r = spark.range(20).select(e, e, e, F.concat(F.lit("https://a/"), "id"), F.lit("T"), F.col("id").cast("string"), e, e, F.concat(F.lit("body "), "id")).toDF(*pages.RECORD)
    pages.write_blocks(r, str(tmp_path / "b"), True)
    files = pages.read_files(spark, str(tmp_path / "b"))
    assert files.filter(F.regexp_count("text", F.lit("URL: ")) > 3).count() == 0
    assert {(x.url, x.body) for x in pages.block_records(files).collect()} == {(f"https://a/{k}", f"body {k}") for k in range(20)}


def test_line_rules_look_first_and_find_the_same(spark):
    odd = ["FEES AND Fees", "FEES FEES", "[H2]FEES and", "- # PART 1 x", "# - Schedule 2", "ab CDEF", "[h2] CDEF", "Һ І Ә Ө x", "ҺІӘӨ", "1. Я", "  1.2 a", "Ab", "A B C D", "ёABCD", "", " - ", "chapter 9 x", "[H1] # 3 Ab", "x ABCD"]
    t = spark.createDataFrame([(x,) for x in [*odd, None, "- Home", "* ANNUAL   Reports", "booK an appointment", "ſhare", "newſ", "Homeİ"]], "x string")

    def heading(line):
        s, letters = T.clean_heading_line(line), F.regexp_replace(T.clean_heading_line(line), f"[^{T.LETTERS}]", "")
        return (s != "") & (F.length(s) <= 140) & (
            s.rlike(r"(?i)^(PART|Schedule|Chapter)\s+\d+") | s.rlike(rf"^\d+(?:\.\d+)*\.?\s+[{T.CAPITALS}]") | ((F.length(letters) >= 4) & (F.upper(letters) == letters)))

    x = F.col("x")
    assert t.filter(~T.is_heading(x).eqNullSafe(heading(x))).count() == 0
    assert t.filter(T.line_key(x).isin(*T.NAV_LINES) & ~F.coalesce(T.is_noise_line(x), F.lit(False))).count() == 0
    assert t.filter(x.rlike(T.NAV_LIKE)).count() >= 2
    assert t.filter(T.useful_word_count(x) != F.regexp_count(x, F.lit(f"[{T.LETTERS}]{{3,}}"))).count() == 0


def test_block_search_holds_a_tile_at_a_time(spark):
    rng = np.random.default_rng(5)
    q, x = rng.normal(size=(4096, 8)), rng.normal(size=(2500, 8))
    column = pa.array([v.tolist() for v in x] + [None, [1.0], [None] * 8, [math.nan] * 8])
    batch = pa.RecordBatch.from_arrays([pa.array([*range(2500), 9000, 9001, 9002, 9003]), column], ["id", "vector"])
    tracemalloc.start()
    found = list(vectors._best_of(SimpleNamespace(value=(list(range(4096)), q)), 3)([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64e6
    scores = np.round(q @ x.T, 9)
    got = sorted((r["query_id"], -r["score"], r["id"]) for part in found for r in part.to_pylist())
    assert [i for _, _, i in got] == [int(i) for row in scores for i in np.lexsort((np.arange(2500), -row))[:3]]


def test_hashed_vectors_are_made_without_a_search_per_slot(spark):
    texts = {1: "The visa fee the", 2: "a b c d e f g", 3: "ß Ä ä 42", 4: None, 5: "!"}
    rows = spark.createDataFrame(list(texts.items()), "id bigint, text string")
    for dim in (256, 100):
        made = text_vectors.hashed_vectors(rows, "id", "text", dim)
        assert "element_at(m" not in made._jdf.queryExecution().analyzed().toString()
        want = {}
        for i in (1, 2, 3):
            v = np.zeros(dim)
            for w in texts[i].lower().split():
                digest = hashlib.md5(w.encode()).hexdigest()
                v[int(digest[:8], 16) % dim] += 1 if int(digest[8], 16) % 2 == 0 else -1
            want[i] = (v / math.sqrt((v * v).sum())).tolist()
        assert {r.id: r.vector for r in made.collect()} == want


def test_reranking_runs_its_search_once(spark):
    docs = spark.createDataFrame([(k, f"visa fee {k} word" + " more" * k) for k in range(30)], "id bigint, text string")
    queries = spark.createDataFrame([(7, "visa fee 3"), (8, "fee more")], "id bigint, text string")
    hits = vectors.top_k_blocks(*(text_vectors.hashed_vectors(x, "id", "text") for x in (queries, docs)), 5)
    best = text_vectors.reranked(hits, queries, docs)
    assert "MapInArrow" not in best._jdf.queryExecution().analyzed().toString()
    assert best.count() == 10 and best.filter("query_id = 7 AND rank = 1").first().id == 3


def test_utterances_are_taken_apart_once(spark):
    said = ["[Background\tNoise]", " (stop) ", "ΣΑΣ Σ", "What is İt?", "(a\nb)", "请问 what", "[music", None, "", "um", "фон ФОН noise", "TELL me about it now"]
    t = spark.createDataFrame(list(enumerate(said)), "id bigint, u string")
    plans = [
        (2, choice_queries.final_turns(t)), (1, t.select(L.is_new_query(F.col("u")).alias("x"))), (1, t.select(L.is_interrupt(F.col("u"), F.lit(-0.5)).alias("x"))),
    ]
    for most, made in plans:
        assert made._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(") <= most
    assert [r.value for r in plans[0][1].orderBy("id").collect()] == [False, True, False, True, False, False, False, None, False, False, False, True]

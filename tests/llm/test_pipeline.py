"""The pipeline against a brute-force version, stage by stage, and the queries against their SQL."""

import hashlib
import math
import random
import re
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from textloom.llm import common, quality_rules, secret_scans, sentencepieces
from textloom.llm.oracles import ORACLE_SQL
from textloom.llm.queries import QUERIES, VOCABULARIES

DATA = Path("/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = common.read(spark, str(DATA), "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.keep(stage(spark, docs, str(DATA)))
        out.append((name, docs.columns, {r["doc_id"]: r.asDict() for r in docs.collect()}))
    return out


def test_stages(spark, stages):
    before = {r["doc_id"]: r.asDict() for r in common.read(spark, str(DATA), "documents").collect()}
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert len(stages) == 5 and all(c == columns for _, c, _ in stages[:-1])
    judged = {r["doc_id"] for r in quality_rules.quality_rules(common.read(spark, str(DATA), "documents")).filter("kept").collect()}
    assert set(stages[0][2]) == judged
    # near copies: every document that goes links, over others, with a smaller one that stays
    sets = {}
    for i, r in stages[0][2].items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r["text"]))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    for _ in sets:
        moved = False
        for a in sets:
            for b in sets:
                if a < b and root[a] != root[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
                    moved = True
        if not moved:
            break
    assert set(stages[1][2]) == {i for i in sets if root[i] == i}
    # secrets: same rows, spans masked
    scanned = secret_scans.secret_scan(spark.createDataFrame([(i, r["text"]) for i, r in stages[1][2].items()], "doc_id bigint, text string"))
    spans = {r["doc_id"]: [(x["s"], x["e"]) for x in r["spans"]] for r in scanned.select("doc_id", "spans").collect()}
    for i, r in stages[1][2].items():
        text, at = "", 0
        for s, e in spans[i]:
            if s >= at:
                text += r["text"][at:s] + "[SECRET]"
            at = max(at, e)
        text += r["text"][at:]
        assert stages[2][2][i]["text"] == text and stages[2][2][i]["n_chars"] == len(text)
    # mixing: a subset, unchanged
    assert set(stages[3][2]) < set(stages[2][2]) and all(stages[2][2][i] == r for i, r in stages[3][2].items())
    # encoding: the library's pieces
    m = sentencepieces.model(f"{VOCABULARIES}/piece_bpe_32k.model")
    assert set(stages[4][2]) == set(stages[3][2])
    for i, r in stages[4][2].items():
        ids = m.library.encode(stages[3][2][i]["text"])
        digest = 0
        for x in ids:
            digest = (digest * sentencepieces.DIGEST_BASE + x + 1) & sentencepieces.WRAP
        assert (r["n_pieces"], r["ids_digest"], r["exact"]) == (len(ids), f"{digest:016x}", True)
    assert before.keys() >= stages[0][2].keys()


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    shown = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else repr(v)
    want = sorted(tuple(map(shown, r)) for r in con.sql(ORACLE_SQL[name]).project(", ".join(columns)).fetchall())
    assert sorted(tuple(map(shown, r)) for r in df.select(*columns).collect()) == want


def test_digest_of_no_spans(spark):
    rows = secret_scans.digest(secret_scans.secret_scan(spark.createDataFrame([(1, "plain")], "doc_id bigint, text string"))).collect()
    assert rows[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def brute_digest(ids):
    digest = 0
    for x in ids:
        digest = (digest * sentencepieces.DIGEST_BASE + x + 1) & sentencepieces.WRAP
    return f"{digest:016x}"


def written(spark, folder, rows):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, kept string, host string, id bigint"
    spark.createDataFrame([(*r, "x", "y", "z", 5) for r in rows], schema).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_run_gives_what_the_stages_give(spark, stages):
    got = {r["doc_id"]: r.asDict() for r in corpus_pipeline.run(spark, str(DATA)).collect()}
    assert got == stages[-1][2]


def test_run_on_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows and ids, and columns that stages use inside."""
    rng = random.Random(3)
    prose = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    secret = f"{prose(20)} password=abcdefgh1234 {prose(20)}"
    long, one, two = prose(30_000), prose(60), prose(60)
    rows = [
        (1, None, "en", "s", None), (2, "", "en", "s", 0), (3, "few words", "en", "s", 9), (None, one, None, None, None), (None, None, None, None, None), (4, two, "en", "s", 1), (4, two, "en", "s", 1),
        (5, one, "de", "s", 1), (6, secret, "en", None, 1), (7, long, None, "s", 1), (8, "same line of words here\n" * 40, "en", "s", 1), (9, two + " more", "en", "t", 1),
    ]
    folder = written(spark, tmp_path, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.read(spark, folder, "documents")
        assert stage(spark, docs, folder).columns == docs.columns, name
    kept = [r["doc_id"] for r in quality_rules.filter_rejected(common.read(spark, folder, "documents")).collect()]
    assert not {1, 2, 3, 8} & set(kept) and kept.count(4) == 2
    got = corpus_pipeline.run(spark, folder).collect()
    m = sentencepieces.model(f"{VOCABULARIES}/piece_bpe_32k.model")
    texts = {"one": one, "two": two, "secret": re.sub("password=abcdefgh1234", "[SECRET]", secret), "long": long, "more": two + " more"}
    known = {brute_digest(ids): (name, len(ids)) for name, t in texts.items() for ids in [m.library.encode(t)]}
    assert got and all(r["exact"] and r["ids_digest"] in known and known[r["ids_digest"]][1] == r["n_pieces"] for r in got)
    # One of the near copies at most, and nothing twice.
    names = [known[r["ids_digest"]][0] for r in got]
    assert len(names) == len(set(names)) and not {"two", "more"} <= set(names)


def test_run_on_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, written(spark, tmp_path, [(1, "x", "en", "s", 1)][:0])).collect() == []

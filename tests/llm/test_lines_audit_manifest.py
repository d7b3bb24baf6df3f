"""Line dedup, the filter audit and the Merkle manifest against brute force on small tables."""

import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from textloom.llm import filter_audit, line_dedup, merkle

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: The columns of documents, and others whose names the operators use inside.
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, h string, g string, n string, part string, pos string, holder string, lines string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, rows):
    """Documents of (doc_id, text, source), n_chars null where the text is."""
    full = [(i, t, None if t == "" else "en", s, None if t is None else len(t), "x", "x", "x", "x", "x", "x", "x") for i, t, s in rows]
    return spark.createDataFrame(full, DOCS)


# Lines.

LINE = "This line is of FORTY characters or more é"


def brute_lines(rows, least, many):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= least:
                holders[k].append(i)
    last = {k: max((i for i in v if i is not None), default=None) for k, v in holders.items() if len(v) >= many}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if last.get(key(x)) in (None, i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def line_rows():
    rng = random.Random(3)
    common = [f"{LINE} number {k}" for k in range(6)]
    texts = [None, "", " \n\t ", LINE[:30], "\n".join([LINE] * 3), "end\r\n" + LINE + "\n", "x" * 39, "x" * 40]
    texts += ["\n".join(rng.choice([c, f"  {c.upper()} \t", f"own line {rng.random()}"]) for c in rng.sample(common, 4)) for _ in range(60)]
    texts += ["y" * 40, "Y" * 40 + "\r", "\x0b" + "y" * 40, "y" * 40 + "\n" + "Y" * 40, "y" * 40]
    texts += ["É" + "z" * 39, "é" + "z" * 39] * 4  # only A-Z are lowered: two keys of four documents each
    return texts


@pytest.mark.parametrize("batches, fanout", [(1, 2), (4, 2), (7, 3)])
def test_line_dedup(spark, batches, fanout):
    rows = list(enumerate(line_rows()))
    random.Random(1).shuffle(rows)
    got = line_dedup.line_dedup(docs(spark, [(*r, "s") for r in rows]), batches=batches, fanout=fanout)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_lines(rows, 40, 5)


def test_line_dedup_of_repeated_and_null_ids(spark):
    texts = line_rows()
    rows = [(i // 2, t) for i, t in enumerate(texts)] + [(40, texts[-20])] * 3 + [(None, t) for t in texts[20:30]] + [(None, "only nulls " * 5)] * 6
    got = line_dedup.line_dedup(docs(spark, [(*r, "s") for r in rows]))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_lines(rows, 40, 5)


def test_line_dedup_of_nothing(spark):
    empty = docs(spark, [(1, "a", "s")]).limit(0)
    assert line_dedup.line_dedup(empty).collect() == []
    only_null = docs(spark, [(None, None, None)])
    assert [tuple(r) for r in line_dedup.line_dedup(only_null).collect()] == [(None, "", 1, 0)]


def test_long_texts_lose_many_lines(spark):
    """A text of 60,000 lines that all go: positions are looked up by hash, not one against all."""
    body = "\n".join(f"{LINE} number {k}" for k in range(60_000))
    rows = [(i, body, "s") for i in range(5)]
    got = sorted(map(tuple, line_dedup.line_dedup(docs(spark, rows)).collect()))
    assert [(i, n, d) for i, _, n, d in got] == [(i, 60_000, 60_000 if i < 4 else 0) for i in range(5)]
    assert got[4][1] == body and got[0][1] == ""


def test_runs_are_merged_without_shuffles(spark):
    """The tables of runs have buckets and order: nothing between them and the merge but what the batch itself needs."""

    def keys(ids):
        rows = spark.createDataFrame([(i, i + 1, i) for i in ids], "h bigint, g bigint, i bigint")
        return rows.groupBy("h", "g").agg(F.count("*").alias("n"), F.max("i").alias("holder"))

    runs = line_dedup.LineRuns(spark, fanout=4, buckets=4)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for ids in (range(0, 50), range(25, 75), range(60, 90)):
            runs.add(keys(ids))
        assert [len(x) for x in runs.levels] == [3]
        with line_dedup._sorted_scans(spark):
            merged = runs.total()
            plan = merged._jdf.queryExecution().executedPlan().toString()
            found = {r["h"]: (r["n"], r["holder"]) for r in merged.collect()}
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
        assert len(runs.runs()) == 2
        times = Counter([*range(0, 50), *range(25, 75), *range(60, 90)])
        assert found == {h: (n, h) for h, n in times.items()}
        runs.add(keys(range(85, 95)))
        runs.add(keys(range(95, 97)))
        assert [len(x) for x in runs.levels] == [0, 1]
        assert {r["h"] for r in runs.fresh(keys(range(80, 100))).filter("fresh").collect()} == set(range(97, 100))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        names = runs.runs()
        runs.close()
    assert not any(spark.catalog.tableExists(name) for name in names)


# Audit.


def brute_audit(rows, labels):
    firsts, good, toxic = {}, {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, x in labels if x == 1} - {None}
    for i, t, _ in rows:
        if i is not None:
            firsts[t or ""] = min(i, firsts.get(t or "", i))
    failing = []
    for i, t, s in rows:
        t = t or ""
        w = WORD.findall(t)
        tests = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), re.search(r"[#$%&*|]", t), i is not None and firsts[t] < i)
        failing.append((s or "", {f for f, x in zip("ABCDE", tests, strict=True) if x}, i in good, i in toxic))
    counts, shapley = defaultdict(lambda: [0] * 6), Counter()
    for part, fails, q, x in failing:
        for order in permutations("ABCDE"):
            first = next((k for k, f in enumerate(order) if f in fails), 9)
            for k, f in enumerate(order):
                c = counts[part, "".join(order), k + 1]
                for n, hit in enumerate((first > k, first == k, f in fails and first < k, fails == {f}, first == k and q, first == k and x)):
                    c[n] += hit
                shapley[part, f] += first == k
    return sorted((*key, *c, shapley[key[0], key[1][key[2] - 1]]) for key, c in counts.items())


def audit_rows():
    rng = random.Random(9)
    many = " ".join(f"w{k}" for k in range(250))
    texts = [None, "", many, many, many, many + " ALL CAPITALS AND MORE OF THEM", many + " #", "same " * 300, "same " * 300, "A|B", "Été " * 250]
    return [(rng.randrange(1000) if k % 9 else None, t, rng.choice([None, "", "a", "b"])) for k, t in enumerate(texts * 4)]


def audited(spark, rows, labels):
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = filter_audit.filter_audit(docs(spark, rows), table)
    return sorted(tuple(r) for r in got.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect())


def test_filter_audit(spark):
    rows = audit_rows()
    ids = [i for i, _, _ in rows if i is not None]
    labels = [(i, k % 2, k % 3 == 0) for k, i in enumerate(ids)] + [(ids[0], 1, 1), (ids[1], None, None), (None, 1, 1), (5000, 1, 1)]
    labels = [(i, q, None if x is None else int(x)) for i, q, x in labels]
    assert audited(spark, rows, labels) == brute_audit(rows, labels)


def test_filter_audit_of_nothing(spark):
    assert audited(spark, [(1, "a", "s")], []) == brute_audit([(1, "a", "s")], [])
    empty = docs(spark, [(1, "a", "s")]).limit(0)
    assert filter_audit.filter_audit(empty, spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).collect() == []


def test_filter_audit_counts_add_up(spark):
    """What is removed, and what is left after the last step, are all documents of a part in every order."""
    rows = [(i, "word " * (i % 7) + "#" * (i % 2), "hot") for i in range(300)]
    got = filter_audit.filter_audit(docs(spark, rows), spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    sums = got.groupBy("filter_order").agg(F.sum("removed").alias("r"), F.min("kept").alias("k")).collect()
    assert len(sums) == 120 and all(r["r"] + r["k"] == 300 for r in sums)


# Manifest.


def h(text):
    return sha256(text.encode()).hexdigest()


def brute_leaf(i, t, s):
    values = (i, s, None if t == "" else "en", None if t is None else len(t), t)
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_tree(leaves):
    """The root, and for each leaf the runs of its path: (place, run) by level."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        runs = [level[k : k + 16] for k in range(0, len(level), 16)]
        for k, p in enumerate(paths):
            p.append((at[k] % 16, runs[at[k] // 16]))
            at[k] //= 16
        level = [h("".join(r)) for r in runs]
    return level[0] if level else None, paths


def brute_manifest(rows):
    parts = defaultdict(list)
    for i, t, s in rows:
        parts[s].append((i, brute_leaf(i, t, s), brute_leaf(i, t and t.translate(LOWER), s)))
    order = sorted(parts, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        parts[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = brute_tree([x[1] for x in parts[s]])
    root, above = brute_tree([trees[s][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for (i, leaf, forged), path in zip(parts[s], trees[s][1], strict=True):
            path = path + above[k]
            node = forged if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else leaf
            for at, run in path:
                node = h("".join(run[:at] + [node] + run[at + 1 :]))
            out.append((i, leaf, trees[s][0], root, h("".join(x for at, run in path for x in run[:at] + run[at + 1 :])), node, node == root))
    return sorted(out, key=repr)


def manifested(spark, rows):
    table = docs(spark, rows)
    got = merkle.manifest(table, merkle.lower_text(table), merkle.tampered(table))
    return sorted((tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


@pytest.mark.parametrize("sizes", [[1], [1, 1], [2, 16, 17, 1], [300, 257, 256, 15], [5000, 1, 33], [3] * 20])
def test_manifest(spark, sizes):
    rng = random.Random(4)
    names = [None, "", "a", "b", "é", "\U0001f600", "￮"] + [f"s{k}" for k in range(20)]
    rows = [(0, t, names[k]) for k, n in enumerate(sizes) for t in (rng.choice([None, "", "lower", f"Upper {rng.random()} é"]) for _ in range(n))]
    rows = [(i * 3 - 7, t, s) for i, (_, t, s) in enumerate(rng.sample(rows, len(rows)))]
    assert manifested(spark, rows) == brute_manifest(rows)


def test_manifest_of_repeated_and_null_ids(spark):
    rows = [(None, None, None)] * 3 + [(None, "A", None)] * 20 + [(5, "x", "s")] * 40 + [(5, "Y", "s"), (4, "Z", "s"), (None, "Z", "s")]
    assert manifested(spark, rows) == brute_manifest(rows)


def test_manifest_of_nothing(spark):
    assert merkle.manifest(docs(spark, [(1, "a", "s")]).limit(0)).collect() == []


def test_proofs_lead_to_the_root(spark):
    """The whole proofs, as a reader of the manifest would check them; one changed byte leads elsewhere."""
    rows = [(i, f"text {i}", f"s{i % 3}") for i in range(900)]
    got = merkle.manifest(docs(spark, rows), paths=True).collect()
    assert all(merkle.folded(r["leaf"], r["ats"], r["sibs"]) == r["root"] == r["folded_root"] and r["verified"] for r in got)
    assert all(merkle.folded(h(r["leaf"]), r["ats"], r["sibs"]) != r["root"] for r in got)


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 4096, 5000])
def test_walk_holds_one_run_and_one_treehash_a_level(n):
    leaves, levels = [h(str(k)) for k in range(n)], merkle.height(n)
    _, paths = brute_tree(leaves)
    for (ats, sibs), path in zip(merkle.walk(leaves, levels), paths, strict=True):
        assert [(a, s) for a, s in zip(ats, sibs, strict=True)] == [(at, "".join(run[:at] + run[at + 1 :])) for at, run in path]
    tree, most = merkle.Treehash(max(levels - 1, 0)), 0
    for leaf in leaves:
        tree.push(leaf)
        most = max(most, sum(map(len, tree.stack)))
    assert most <= 16 * max(levels, 1)

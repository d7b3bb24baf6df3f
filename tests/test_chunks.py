import pytest
from pyspark.sql import functions as F

from textloom.functions import numbers
from textloom.operators import chunks, ranks


@pytest.mark.parametrize(
    "lang, pairs",
    [
        ("en", {21: "twenty one", 105: "one hundred five", 1_000_000: "one million", -5: "minus five"}),
        ("ru", {2000: "две тысячи", 1000: "одна тысяча", 21: "двадцать один"}),
        ("kk", {15: "он бес", 20: "жиырма", 10: "он нөл", 110: "бір жүз он нөл"}),
        ("zh", {15: "十五", 105: "一百零五", 110: "一百十", 2024: "二零二四"}),
    ],
)
def test_spelled(spark, lang, pairs):
    rows = spark.createDataFrame([(k,) for k in pairs], "x bigint").selectExpr("x", f"{numbers.spelled(lang, 'x')} AS w").collect()
    assert {r["x"]: r["w"] for r in rows} == pairs


def test_hard_split():
    assert [len(c) for c in chunks.packed("x" * 5000, 400)] == [1600, 1600, 1600, 200]


def test_packing_keeps_all_parts_and_overlaps():
    parts = [f"Sentence {i} is here. It says {i}." for i in range(40)]
    out = list(chunks.packed("\n\n".join(parts), 60, 10))
    assert len(out) > 5 and all(any(p in c for c in out) for p in parts)
    assert all(b.startswith(a.split("\n\n")[-1].split(". ")[-1][:5]) or "It says" in b for a, b in zip(out, out[1:], strict=False))


def test_chunks_of_odd_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "one line"), (4, "a. " * 3000)], "doc_id bigint, text string")
    out = chunks.chunks(df, "faq").groupBy("id").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("m")).collect()
    assert {r["id"]: r["n"] for r in out}.keys() == {3, 4} and all(r["m"] <= 4 * 400 + 400 for r in out)


def test_repaired_lines(spark):
    lines = ["A line that goes", "on here", "and on.", "- bullet", "[H2] Head", "text", ", more", "", "", "TITLE LINE", "next", "", ""]
    out = spark.createDataFrame([(lines,)], "l array<string>").select(chunks.repaired(F.col("l")).alias("o")).first()["o"]
    assert out == ["A line that goes on here and on.", "- bullet", "[H2] Head", "text, more", "", "TITLE LINE", "next"]


def test_global_row_number(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("k"))
    assert ranks.global_row_number(df, "k").filter("k <> n").count() == 0


@pytest.fixture(scope="module")
def pieces(spark):
    from textloom.operators import chunkers
    from textloom.plans import page_queries as Q

    own = spark.createDataFrame(list(enumerate(Q._fixed_texts)), "doc_id int, text string")
    return lambda name, k: [r for r in chunkers.STRATEGIES[name](own.filter(F.col("doc_id") == k)).orderBy("chunk_index").collect()]


def test_chunkers_by_kind(pieces):
    faq = pieces("faq", 0)
    assert [r["section_title"] for r in faq][0] == "1. What is it?" and {r["section_title"] for r in faq} == {"1. What is it?", "3. Long one?"} and len(faq) > 2
    policy = pieces("policy", 2)
    # The opening and what follows it stay together while they are small; contents lines are gone.
    assert [r["section_title"] for r in policy][:2] == ["Introduction", "1.2 Rules of conduct"] and "1.1 Aim\nsmall" in policy[0]["text"]
    assert policy[-1]["section_title"] == "Schedule 1 Forms" and not any("....." in r["text"] for r in policy)
    report = pieces("report", 3)
    assert [r["is_table"] for r in report][:2] == [False, True] and report[1]["text"].startswith("**Results**") and all("short" not in r["text"].split() for r in report[:2])
    assert all(r["section_title"] in ("Results", "More") and r["token_estimate"] <= 880 for r in report)
    guide = pieces("guidebook", 4)
    assert [(r["section_title"], r["is_table"]) for r in guide] == [
        ("EMPLOYMENT VISA – 1. Documents for the visa are these", False), ("EMPLOYMENT VISA – 1. Documents for the visa are these", True),
        ("EMPLOYMENT VISA – Step 2 and then", False), ("OTHER SERVICE – Overview", False),
    ]
    assert [r["text"] for r in pieces("guidebook", 2)] == [r["text"] for r in policy]
    web = pieces("web", 5)
    assert web[0]["text"].startswith("URL: http://a/1\nTitle: First\nSection: News\n\n## First\n\n") and len({r["section_title"] for r in web}) == 3
    assert [r["chunk_index"] for r in web] == list(range(len(web))) and all("Home page" not in r["text"] for r in web)
    assert pieces("single", 7) == [] and len(pieces("single", 6)) == 1


def test_pages(spark):
    from textloom.operators import pages

    t = spark.createDataFrame([("ﬁne\xa0 text •item\n o  bullet\n\n\n\n\nend ①",), (None,)], "t string").select(pages.normalized(F.col("t")).alias("t"))
    assert [r["t"] for r in t.collect()] == ["fine text -item\n- bullet\n\n\nend 1", ""]
    body = "Home\n[H2] Title\n- menu\nA longer sentence that gets wrapped\nover two lines.\nand\nA longer sentence that gets wrapped\n"
    out = pages.clean_bodies(spark.createDataFrame([(1, body), (2, "")], "id int, body string"))
    assert {r["id"]: r["body"] for r in out.collect()} == {1: "[H2] Title\nA longer sentence that gets wrapped over two lines.", 2: ""}

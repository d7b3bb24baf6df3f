"""Every query with SQL of its own against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"]


def shown(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_matches_duckdb(spark, duck, name):
    df = entry.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted(tuple(map(shown, r)) for r in df.select(*columns).collect())
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    want = sorted(tuple(map(shown, r)) for r in rel.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert got == want
    if df.columns and name != "repeated_question_match":
        assert got


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_listing_names_tables_that_are_folders(spark, tmp_path):
    folder = tmp_path / "sf1.5"
    for table in ("one.parquet", "two.parquet"):
        spark.range(9).repartition(3).write.parquet(str(folder / table))
    spark.range(3).toPandas().to_parquet(folder / "three.parquet")
    assert sorted(r.name for r in entry.queries()["scan_glob_listing"](spark, str(folder)).collect()) == ["one.parquet", "three.parquet", "two.parquet"]

"""Row numbers and positions that need no single task to see all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.sources import shared


def global_row_number(df: DataFrame, *order: str, name: str = "n") -> DataFrame:
    """Rows numbered from 0 in the order of columns that tell all rows apart.

    Rows are dealt out by range, counted by part, and numbered within their part on top of the counts before it: the
    only thing that one task sees whole is one count per part. What was dealt out is written once, as another sample of
    the rows might deal them otherwise for the counts."""
    dealt = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    place = shared.folder(df.sparkSession, "ranks")
    dealt.write.parquet(place)
    parts = df.sparkSession.read.schema(dealt.schema).parquet(place)
    counts = parts.groupBy("__part").agg(F.count("*").alias("__count"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__count").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    return parts.withColumn("__own", own).join(offsets, "__part").withColumn(name, F.col("__before") + F.col("__own") - 1).drop("__part", "__own", "__before")


def first_of_each(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order, as a partially aggregated minimum."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return first.select(*keys, "__row.*")

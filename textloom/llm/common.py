"""Helpers that several operators share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule `[^\x20\x09-\x0D]+` besides the plain blank.
OTHER_SPACE = "\t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Array of the words of a text, in order; null text has none."""
    flat = F.coalesce(text, F.lit(""))
    for space in OTHER_SPACE:  # replace() searches bytes, which costs far less than translate()
        flat = F.replace(flat, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(flat, " ", -1), "")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is named and all runs in one process (tests), a temporary one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="textloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def keep(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder once and read it from there afterwards: it survives lost
    executors, and what is behind it does not run again."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that extra columns of the input can't clash with an operator's own."""
    return df.select(*[df[c] for c in columns])


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of frames that are no longer in use; it acts on the driver's
    garbage collection, which a small driver heap may put off for long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def written(df: DataFrame):
    """The frame as a compressed table in the shared folder, for as long as the block lasts. For large frames that
    are read more than once; what is returned from the block must be kept before it ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    release(spark)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        delete(spark, path)
        release(spark)

"""Tables in the folder that driver and executors share, and streams that end."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def folder(spark: SparkSession, name: str) -> str:
    """A new place in the cluster's shared folder; where none is named and all runs in one process, in a temporary one."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not shared:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="textloom-")
        sc.setCheckpointDir(shared)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(rows: DataFrame, name: str) -> DataFrame:
    """The rows, written once to the shared folder, for several readers."""
    place = folder(rows.sparkSession, name)
    rows.write.parquet(place)
    return rows.sparkSession.read.schema(rows.schema).parquet(place)


def bounded_stream(spark: SparkSession, source: str, make: Callable[[DataFrame], DataFrame], **options) -> DataFrame:
    """The rows that a stream over the files of a Parquet table gives until it has read them all. It runs in a session of
    its own, as keyed state needs the RocksDB store; rows and state go to the shared folder."""
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    # A pattern, as a stream takes a table of one file for a folder otherwise.
    stream = session.readStream.schema(session.read.parquet(source).schema).options(**options).parquet(f"{source[:-1]}[{source[-1]}]")
    out = make(stream)
    place = folder(spark, "stream")
    query = out.writeStream.format("parquet").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start(f"{place}/rows")
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{place}/rows")

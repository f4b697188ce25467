"""Files that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir; a local session without it, as in tests, gets its own folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="proxsearch-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        root = "file://" + _OWN[0]
    return f"{root.rstrip('/')}/proxsearch/{uuid.uuid4().hex}"


#: Rows and bytes handed to Python at once, so that a worker's memory doesn't grow with the texts' lengths; a longer text comes alone.
ARROW_ROWS, ARROW_BYTES = 500, 32 << 20


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of ARROW_ROWS rows and about ARROW_BYTES, unless the session has settings of its own.

    Plans read these settings when they run, which is after the operator has returned, so they stay set.
    """
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(most))


def number_rows(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """``df`` with ``name``: start + 1, start + 2, ... in the order of ``order``, without a single-task sort.

    Range partitions are sorted and written with their row numbers; only the sizes of the partitions reach the driver.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()).write.parquet(path)
    part = spark.read.parquet(path).withColumn("_p", F.shiftright("_m", 33))
    at, rows = start, []
    for r in sorted(part.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()):
        rows.append((r["_p"], at))
        at += r["n"]
    offsets = F.broadcast(spark.createDataFrame(rows, "_p long, _at long"))  # one row a partition
    within = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return part.join(offsets, "_p").select(*df.columns, (F.col("_at") + within + 1).alias(name))


def filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def put_numbered(spark: SparkSession, folder: str, number: int, text: str) -> None:
    """A new small file, complete or not there at all; an error if ``number`` is there already, so of two writers one fails."""
    fs, place = filesystem(spark, f"{folder}/{number:012d}.json")
    _, part = filesystem(spark, f"{folder}/.{uuid.uuid4().hex}.tmp")
    out = fs.create(part, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        done = not fs.exists(place) and fs.rename(part, place)
    finally:
        fs.delete(part, False)
    if not done:
        raise RuntimeError(f"{place} was written by another")


def newest_text(spark: SparkSession, folder: str) -> str | None:
    """The file of the highest number of put_numbered; None if there is none."""
    fs, where = filesystem(spark, folder)
    if not fs.exists(where):
        return None
    names = sorted(n for s in fs.listStatus(where) if (n := s.getPath().getName()).endswith(".json"))
    return read_text(spark, f"{folder}/{names[-1]}") if names else None


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, where = filesystem(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()

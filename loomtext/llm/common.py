"""What the training-data operators share: table access, the shared folder and digests."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only in local mode, where none need be named, it is one of our own, which
    goes with the process; a cluster without one is an error."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(own := tempfile.mkdtemp(prefix="loomtext-"))
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        named = spark.sparkContext.getCheckpointDir()
    return named


ROWS_TO_PYTHON = 2000


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet to the shared folder and read back: later steps start from the files, whichever
    executors are lost, and Spark knows their size. While it is written, Python workers get rows in small batches, since
    texts are long."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    path = f"{shared_dir(spark)}/loomtext-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), ROWS_TO_PYTHON) if int(before) > 0 else ROWS_TO_PYTHON))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def doc_fold(c: Column, folds: int) -> Column:
    """crc32 of the id's decimal text modulo folds; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def most_frequent(rows: DataFrame, count: str, most: int, key: str) -> DataFrame:
    """At most `most` rows with the largest counts: those above a count that a histogram of at most 4096 steps of 2 to
    the 1/64 shows, and of the step that does not fit whole as many as fit by 4096 buckets of the key's hash. A sort with
    a limit would send as many rows from each task."""
    steps, bucket = F.floor(F.log2(F.col(count).cast("double")) * 64), F.pmod(F.xxhash64(key), F.lit(4096))
    left, least, edge = most, None, None
    for r in sorted(rows.groupBy(steps.alias("step")).count().collect(), reverse=True):
        if r["count"] > left:
            edge = r["step"]
            break
        left, least = left - r["count"], r["step"]
    kept = F.lit(False) if least is None else steps >= least
    if edge is not None and left:
        upto = -1
        for r in sorted(rows.filter(steps == edge).groupBy(bucket.alias("bucket")).count().collect()):
            if r["count"] > left:
                break
            left, upto = left - r["count"], r["bucket"]
        kept = kept | ((steps == edge) & (bucket <= upto))
    return rows.filter(kept)

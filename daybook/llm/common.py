"""Shared pieces of the corpus operators: scratch tables in the shared folder, word patterns, safe column choice."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Words between ASCII white space, and words of letters, digits and non-ASCII characters (after lower-casing A-Z).
SPACED_WORD = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch, which holds whole texts, in the JVM and in a Python worker.
BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the session names none, one of our own in local mode alone: on a cluster executors
    couldn't see each other's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        context = spark.sparkContext
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _own.get(context.applicationId) or tempfile.mkdtemp(prefix="daybook-checkpoints-")
        _own[context.applicationId] = folder
    return folder.rstrip("/")


class Scratch:
    """Tables written to the shared folder: they cut lineage, and outlive lost executors."""

    made: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.names = spark, set()
        self.made.append(self)
        if spark.conf.get(BATCH_SETTING) == "10000":  # Spark's own default: ten thousand texts are too much to hold at once
            spark.conf.set(BATCH_SETTING, BATCH_ROWS)
        self.root = f"{shared_folder(spark)}/daybook-{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").mode("overwrite").parquet(path)
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Shuffle files of finished queries stay until the driver's references to them are collected. This asks for it now, where an
        operator would else hold the whole text twice on disk."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, name: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(conf).delete(path, True)
        self.names.discard(name)

    def clear(self, keep: str = "") -> None:
        for name in self.names - {keep}:
            self.drop(name)

    def result(self, df: DataFrame) -> DataFrame:
        """Writes what an operator returns, and removes the tables that led to it."""
        done = self.table(df, "result")
        self.clear("result")
        return done


def swept(step):
    """What `step` gives, once it has written it, with all tables removed that operators left behind on the way."""
    first = len(Scratch.made)
    done = step()
    for scratch in Scratch.made[first:]:
        scratch.clear()
    del Scratch.made[first:]
    return done


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of input that a bucket stands for at most.
BUCKET = 64 << 20


def buckets_for(df: DataFrame) -> int:
    """How many buckets rows made from `df` are dealt into: by its size, so that a bucket's memory has a bound, and enough for
    all tasks."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(max(partitions(df.sparkSession), size // BUCKET), 1 << 20)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone, as the word rules of these operators ask."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced_words(text: Column) -> Column:
    """Words between ASCII white space; none for null. All white space is made a space first: that splits without a pattern."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", " " * 5)
    return F.array_remove(F.split(spaced, " "), "")

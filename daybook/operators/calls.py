"""The log of a model's calls: every prompt is asked once, written, and read by all that need its answer.

Answers are kept by a hash of all that they hang on: the kind of call, the model, its weights, the prompt and the options. A run takes
its prompts apart into known and unknown keys, asks the unknown ones once each, and writes them before anything reads an answer. So an
unchanged run asks nothing, and a lost executor makes Spark read the log again, not the model.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from . import model
from .buckets import missing

LOG = "key string, kind string, model string, value string, error string, run string"


class CallLog:
    """Answers in a folder, dealt by the first two digits of their keys: a run reads the folders of its own keys."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, heads: list[str]) -> DataFrame:
        try:
            return self.spark.read.schema(f"{LOG}, head string").parquet(self.folder).where(F.col("head").isin(*heads)).drop("head")
        except AnalysisException as wrong:
            if not missing(wrong):
                raise
            return self.spark.createDataFrame([], LOG)

    def answers(self, prompts: DataFrame, client: model.Client, kind: str, options: dict | None = None) -> DataFrame:
        """(id, value, error) for `prompts` (id, prompt). Only what isn't known is asked, equal prompts once.

        A failed call is an error in this run's answers, and asked again in the next run. A lost connection stops the run; what other
        tasks have answered by then isn't kept.
        """
        run = uuid.uuid4().hex
        keyed = prompts.select(F.col("id").cast("long").alias("id"), "prompt", model.memo_key(kind, model.identity(client), F.col("prompt"), options).alias("key"))
        heads = sorted(r.h for r in keyed.select(F.substring("key", 1, 2).alias("h")).distinct().collect())  # 256 at most
        known = self._read(heads).where("error IS NULL").select("key").distinct()
        unknown = keyed.dropDuplicates(["key"]).join(known, "key", "left_anti")
        asked = model.call(unknown.withColumn("id", F.lit(0).cast("long")).select("id", "prompt", "key"), client, kind, options=options)
        rows = asked.select("key", F.lit(kind).alias("kind"), F.lit(model.identity(client)).alias("model"), "value", "error", F.lit(run).alias("run"), F.substring("key", 1, 2).alias("head"))
        rows.write.partitionBy("head").mode("append").parquet(self.folder)
        held = self._read(heads).where(F.col("error").isNull() | (F.col("run") == run))
        best = held.groupBy("key").agg(F.min(F.struct(F.col("error").isNotNull().alias("failed"), "value", "error")).alias("a"))
        return keyed.select("id", "key").join(best, "key").select("id", "a.value", "a.error")

"""Tables in buckets by file, with a manifest for each commit: a changed file rewrites its buckets alone, readers see a commit whole.

A table's rows carry the path of the file that they came from. A commit writes the buckets of the files it is about, as a new version
beside the old ones, and last a manifest: which version holds each bucket of each table. A reader takes one manifest and reads what it
names, so it sees the state before or after a commit, never a part; a run that breaks off leaves versions that no manifest names.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

MANIFEST = "number int, buckets int, name string, schema string, versions array<int>, meta map<string,string>"
#: Buckets of a new store; a bucket's share of the files is what one changed file rewrites.
BUCKETS = 64
PATH = "_path"
#: Tables that are written at a time.
WRITES = 6


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def missing(wrong: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in str(wrong)


class BucketStore:
    """The tables of a folder as of one commit, the last by default. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str, number: int | None = None, buckets: int | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.number, self.buckets, self.meta, self.tables = 0, buckets or BUCKETS, {}, {}
        try:
            known = spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifests")
            last = known.agg(F.max("number")).first()[0] if number is None else number
            rows = known.where(F.col("number") == last).collect()  # a row a table
        except AnalysisException as wrong:
            if not missing(wrong):
                raise
            rows = []
        for r in rows:
            self.number, self.buckets, self.meta = r.number, r.buckets, dict(r.meta)
            self.tables[r.name] = (r.schema, list(r.versions))

    def bucket(self, path) -> object:
        return F.pmod(F.xxhash64(path), F.lit(self.buckets)).cast("int")

    def _rows(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table with the path of each row, of some buckets or all."""
        schema, versions = self.tables[name]
        by_version: dict[int, list[int]] = {}
        for k, version in enumerate(versions):
            if version and (buckets is None or k in buckets):
                by_version.setdefault(version, []).append(k)
        parts = [self.spark.read.schema(f"{schema}, bucket int").parquet(f"{self.folder}/data/{name}/{v}").where(F.col("bucket").isin(*own)).drop("bucket") for v, own in by_version.items()]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], StructType.fromDDL(schema))

    def table(self, name: str) -> DataFrame:
        return self._rows(name).drop(PATH)

    def commit(self, changes: dict[str, tuple[DataFrame, DataFrame]], meta: dict[str, str] | None = None) -> BucketStore:
        """The state after `changes`: of each named table the rows of some files (path) give way to new ones, which carry `_path`.

        Files without new rows are gone from that table. What isn't named stays as it is, without being read or written.
        """
        number = self.number + 1
        with ThreadPoolExecutor(WRITES) as pool:  # small tables are many short jobs: several at a time
            written = pool.map(lambda name: (name, self._write(number, name, *changes[name])), changes)
            tables = self.tables | {name: made for name, made in written if made}
        meta = self.meta | (meta or {})
        rows = [(number, self.buckets, name, schema, versions, meta) for name, (schema, versions) in tables.items()]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifests")
        return BucketStore(self.spark, self.folder, number)

    def _write(self, number: int, name: str, new: DataFrame, files: DataFrame) -> tuple[str, list[int]] | None:
        """A table's new version: its schema, and which version holds each bucket. None where there is nothing to do."""
        files = files.select("path").distinct()
        touched = sorted(r.b for r in files.select(self.bucket(F.col("path")).alias("b")).distinct().collect())  # as many as buckets at most
        schema, versions = self.tables.get(name, (None, [0] * self.buckets))
        if not touched and schema:
            return None
        rows = new
        if schema:
            rest = self._rows(name, touched).join(files.withColumnRenamed("path", PATH), PATH, "left_anti")
            rows = rest.unionByName(new, allowMissingColumns=True)
        placed = rows.withColumn("bucket", self.bucket(F.col(PATH)))
        placed.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.folder}/data/{name}/{number}")
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), [number if k in touched else v for k, v in enumerate(versions)]

    def vacuum(self) -> list[str]:
        """Removes the versions that this commit doesn't name. Not while an older commit is still being read."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        gone = []
        for name, (_, versions) in self.tables.items():
            top = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/data/{name}")
            system = top.getFileSystem(conf)
            for status in system.listStatus(top):
                version = status.getPath().getName()
                if version.isdigit() and int(version) not in versions and int(version) <= self.number:
                    system.delete(status.getPath(), True)
                    gone.append(f"{name}/{version}")
        return sorted(gone)

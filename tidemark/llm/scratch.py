"""Written tables that cut lineage, in the folder that the session names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession


#: Bytes of a row group of scratch tables: what a writer holds in memory before it writes.
ROW_GROUP = 8 << 20


def checkpoint_root(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where it names none, a temporary folder serves a local master;
    on a cluster, where executors do not share the driver's folders, that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = current.get() if current.isDefined() else tempfile.mkdtemp(prefix="tidemark-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root


def input_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of a frame's size (the file sizes, for a plain scan)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small_batches(spark: SparkSession, rows: int = 2000, size: int = 4 << 20) -> None:
    """Texts are long: hand them to Python workers in batches of fewer rows and bytes than Spark's defaults,
    unless the session already asks for less. It stays so for the session, as plans run after they are
    made."""
    for key, most, default in (("maxRecordsPerBatch", rows, 10_000), ("maxBytesPerBatch", size, 1 << 30)):
        key = f"spark.sql.execution.arrow.{key}"
        now = re.fullmatch(r"(-?\d+)b?", spark.conf.get(key, str(default)))  # a value with a unit is the user's
        if now and not 0 < int(now[1]) <= most:
            spark.conf.set(key, most)


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def folder_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any file system that Spark reads; none if there is no such folder."""
    fs, p = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


#: Has Spark delete the shuffle files of a query at its end.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Queries inside leave no shuffle files behind, which else stay until the driver happens to collect its garbage."""
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(TIDY)
        else:
            spark.conf.set(TIDY, before)


class Scratch:
    """Parquet tables of one query, under one folder of their own. With ``tidy``, the shuffle files of a table are
    deleted as soon as it is written."""

    def __init__(self, spark: SparkSession, name: str, tidy: bool = False):
        self.spark, self.tidy = spark, tidy
        small_batches(spark)
        self.root = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:04d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back."""
        path = self.path(name)
        with tidied(self.spark) if self.tidy else nullcontext():
            df.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    @contextmanager
    def resident(self, df: DataFrame, keys: Sequence[str], name: str) -> Iterator[DataFrame]:
        """Write ``df`` bucketed by ``keys``, a file a bucket: joins on all of the keys leave it where it is. The
        catalog knows the table until the end of the block; its files stay in the scratch folder."""
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        table = f"tidemark_{name}_{uuid.uuid4().hex}"
        dealt = df.repartition(parts, *keys)
        dealt.write.format("parquet").bucketBy(parts, *keys).option("parquet.block.size", ROW_GROUP).option("path", self.path(name)).saveAsTable(table)
        try:
            yield self.spark.table(table)
        finally:
            self.spark.sql(f"drop table if exists {table}")

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for df in frames:
            delete(self.spark, df._scratch_path)

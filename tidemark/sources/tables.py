"""Tables written once and read back, in the shared folder that the session names, and small driver files
on any file system that Spark reads."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the driver has written and not yet deleted: folders, and the names of those that the catalog knows.
_KEPT: list[tuple[SparkSession, str, str | None]] = []


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a temporary folder serves a local master; on a cluster,
    where executors do not share the driver's folders, that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Rows that one task of a shuffle is to sort, about.
ROWS = 1 << 18


def parts_for(spark: SparkSession, rows: int) -> tuple[int, ...]:
    """The number of partitions, as the first argument of a repartition, that gives a task about ``ROWS`` rows however
    many there are; none while the session's own number does, so that small tables are not cut up."""
    parts, own = -(-rows // ROWS), min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return (parts,) if parts > own else ()


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """The frame as a Parquet table: what several steps need is computed once and outlives executors. It
    stays until ``release``, the end of a ``scope`` or that of the driver, as frames over it are lazy."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _KEPT.append((spark, path, None))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, keys: Sequence[str], name: str = "table") -> DataFrame:
    """As ``written``, bucketed: windows, aggregations and joins on (at least) all of ``keys`` shuffle it no
    more."""
    spark = df.sparkSession
    path, table = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}", f"tidemark_{name}_{uuid.uuid4().hex}"
    _KEPT.append((spark, path, table))
    save_bucketed(df, path, keys, table)
    return spark.table(table)


def save_bucketed(df: DataFrame, path: str, keys: Sequence[str], table: str, order: Sequence[str] = ()) -> int:
    """Writes a folder with one file for each bucket, sorted by ``order``, and names it in the catalog; the
    number of buckets."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = df.repartition(buckets, *(F.col(f"`{k}`") for k in keys)).write.format("parquet").mode("overwrite").bucketBy(buckets, *keys)
    (out.sortBy(*order) if order else out).option("path", path).saveAsTable(table)
    return buckets


def _catalog_name(path: str) -> str:
    return f"tidemark_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"


def forget_bucketed(spark: SparkSession, path: str) -> None:
    """Takes a folder that ``open_bucketed`` has named out of the catalog; its files stay."""
    spark.sql(f"drop table if exists {_catalog_name(path)}")


def open_bucketed(spark: SparkSession, path: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """A folder of ``save_bucketed`` that this session's catalog may not know yet."""
    table = _catalog_name(path)
    fields = spark.read.parquet(path).schema
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    forget_bucketed(spark, path)
    spark.sql(f"create table {table} ({columns}) using parquet clustered by ({', '.join(f'`{k}`' for k in keys)}) into {buckets} buckets location '{path}'")
    return spark.table(table)


def release(spark: SparkSession, since: int = 0) -> None:
    """Deletes what ``written`` and ``written_by`` have kept (from the ``since``-th on)."""
    for own, path, table in _KEPT[since:]:
        if own is spark:
            with suppress(Exception):  # the session may be over
                if table:
                    spark.sql(f"drop table if exists {table}")
                fs, p = _at(spark, path)
                fs.delete(p, True)
    _KEPT[since:] = [x for x in _KEPT[since:] if x[0] is not spark]


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at its end; frames over them are to be used up by then."""
    since = len(_KEPT)
    try:
        yield
    finally:
        release(spark, since)


@atexit.register
def _release_all() -> None:
    for spark in {id(x[0]): x[0] for x in _KEPT}.values():
        with suppress(Exception):
            if not spark.sparkContext._jsc.sc().isStopped():
                release(spark)


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file of the driver, replaced as a whole."""
    fs, p = _at(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    if not exists(spark, path):
        return None
    return spark.sparkContext.wholeTextFiles(path).values().first()

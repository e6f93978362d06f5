"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words in most contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[ \x09-\x0D]+"
NOT_SPACE = r"[^ \x09-\x0D]+"
#: Tables written by this process.
_WRITTEN: list[str] = []
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder, read by Spark so that any file system works.

    A table in fewer splits than there are cores, such as one small file, is dealt over
    all of them first: the work on a text costs far more than moving it.
    """
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; on a cluster spark.checkpoint.dir must name it."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:  # tests on one machine
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="kvtide-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back: computed once, lineage cut, safe if executors are lost.

    Unlike checkpoint(), which runs the plan twice, this runs it once. An empty
    frame keeps its schema, as the read uses it explicitly.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kvtide-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def small(table: DataFrame, rows: int = 100_000, size: int = 8 << 20) -> DataFrame:
    """A written table, marked for broadcast if its rows were counted and its files measured to be few; otherwise the join is left to the optimizer, which splits skewed keys."""
    held = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(table) if held <= size and table.count() <= rows else table


def sweep(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Deletes the tables that written() made in this process, but for the first since and the last keep, once nothing reads them any more; returns their number."""
    path, n = spark._jvm.org.apache.hadoop.fs.Path, 0
    gone = _WRITTEN[since : len(_WRITTEN) - keep]
    del _WRITTEN[since : len(_WRITTEN) - keep]
    for x in gone:
        p = path(x)
        n += bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True))
    return n


def swept_from() -> int:
    """The number of tables written so far, to sweep those that come after."""
    return len(_WRITTEN)


def boxed(docs: DataFrame) -> DataFrame:
    """The rows as one column, ``row``, so that no name of an operator's working columns can clash with theirs; ``row.*`` brings them back."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(c, UPPER, LOWER)


def parts_for(df: DataFrame, rows: int = 0, per_part: int = 1 << 20) -> int:
    """The session's number of shuffle partitions, or more if a partition would get over per_part of so many rows."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_part))


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that gives its memory back at the end: Python workers stay for later tasks, and what they hold counts."""

    @wraps(run)
    def trimmed(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not glibc
                pass

    return trimmed

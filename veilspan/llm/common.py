"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def null_safe(left: DataFrame, right: DataFrame, cols: list[str], how: str = "inner") -> DataFrame:
    """Join on ``cols`` where null equals null; the right side's key columns are dropped."""
    other = right.select(*[F.col(c).alias(f"__r_{c}") if c in cols else F.col(c) for c in right.columns])
    on = reduce(lambda a, b: a & b, [left[c].eqNullSafe(other[f"__r_{c}"]) for c in cols])
    joined = left.join(other, on, how)
    return joined.drop(*[f"__r_{c}" for c in cols]) if how not in ("left_semi", "left_anti") else joined


def fold_name(c: Column) -> Column:
    """Lower case without any blanks; empty becomes null."""
    s = F.regexp_replace(F.lower(c), r"[\s ]+", "")
    return F.when(s != "", s)


def fold_kind(c: Column) -> Column:
    """As fold_name, where hyphens and underscores count as blanks too."""
    s = F.regexp_replace(F.lower(c), r"[\s _\-]+", "")
    return F.when(s != "", s)


def shared_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go where ``spark.checkpoint.dir`` says.  Only a session on one machine
    that names no folder gets a temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="veilspan-checkpoints-")
    sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df`` written to the shared checkpoint folder, with a short lineage."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def _freeing(spark: SparkSession) -> Iterator[None]:
    """Within it, a job's shuffle files are removed as soon as its rows are written."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def settled(df: DataFrame) -> DataFrame:
    """As ``cut``; the shuffle files that the rows came through are removed at once."""
    with _freeing(df.sparkSession):
        return cut(df.select("*"))


def stored(df: DataFrame, codec: str) -> tuple[DataFrame, Callable[[], None]]:
    """The rows of ``df`` as compressed files in the shared checkpoint folder, and what removes them.
    Checkpoints are not compressed and stay until the driver collects its garbage."""
    spark = df.sparkSession
    shared_checkpoints(spark)
    sc = spark.sparkContext
    path = f"{sc._jsc.sc().getCheckpointDir().get()}/stored-{uuid.uuid4().hex}"
    with _freeing(spark):
        df.write.option("compression", codec).parquet(path)

    def remove() -> None:
        place = sc._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)

    return spark.read.schema(df.schema).parquet(path), remove


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """Rows dealt over at least ``least`` partitions (default: the session's parallelism), for
    inputs of few files whose per-row work is heavy.  A pass-through when there are enough."""
    least = least or df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= least else df.repartition(least)

"""Session helpers of this subpackage: reading tables, cutting lineage, sizing."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark only (any store that Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    Where neither that setting nor the context names any, a temporary one is made in
    a local session, as in tests; on a cluster it is an error, since executors could
    not share it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="corpuscle-"))
    return context.getCheckpointDir()


#: Shuffle files of a query go when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaning(spark: SparkSession) -> Iterator[None]:
    """Queries planned within delete their shuffle files as they end; else these stay until the driver happens to collect its garbage."""
    old = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN) if old is None else spark.conf.set(_CLEAN, old)


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the shared folder, so that a lost executor costs no recomputation; its shuffle files go."""
    shared_folder(df.sparkSession)
    with cleaning(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def spent(df: DataFrame) -> None:
    """Delete the files of ``df``, a result of :func:`cut` that nothing reads any more."""
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    forget(df.sparkSession, file.get())


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(col: str, mod: int):
    """``crc32`` of the id as text, modulo ``mod``."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(mod)


def packed(df: DataFrame) -> DataFrame:
    """All columns as one struct ``row``, so that no name of theirs meets a name of ours."""
    return df.select(F.struct("*").alias("row"))


def unpacked(df: DataFrame, columns: list[str], **instead) -> DataFrame:
    """The columns of ``row`` again, some of them replaced."""
    return df.select(*(instead.get(c, F.col("row").getField(c)).alias(c) for c in columns))


def forget(spark: SparkSession, path: str) -> None:
    """Delete what a run has written under the shared folder and nobody reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

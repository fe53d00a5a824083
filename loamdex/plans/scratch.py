"""Shared scratch tables: how a plan is cut without keeping data on one machine.

Intermediate results are written as Parquet below the folder that the cluster names in
``spark.checkpoint.dir``; every executor can read them again after any other was lost. Where the setting is
missing a temporary folder stands in, but only in local mode, where all tasks share one disk; on a cluster that is an
error, since each executor would write to its own.

What a result reads from scratch tables stays until ``release``, the end of a ``released`` block, or the end of the process.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"
_local: dict[str, str] = {}
_made: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session, or in local mode a folder of this process where none is set."""
    named = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING, None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"{_SETTING} must name a folder that all executors of {master} share")
    if "root" not in _local:
        _local["root"] = tempfile.mkdtemp(prefix="loamdex-")
        atexit.register(shutil.rmtree, _local["root"], True)
    return "file://" + _local["root"]


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has yet and that ``release`` deletes."""
    if not _made:
        atexit.register(_end, spark)
    _made.append(f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once as a shared table and returns the table, so that no later step computes it again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str, of: Column | None = None) -> tuple[DataFrame, int]:
    """As ``materialize``, with the number of rows, or another whole sum over them, which the write itself takes."""
    seen = Observation()
    table = materialize(df.observe(seen, (F.count(F.lit(1)) if of is None else of).alias("n")), name)
    return table, seen.get["n"] or 0


def release(spark: SparkSession, after: int = 0) -> None:
    """Deletes the shared tables that this process wrote, but for the first ``after``; results that still read them are over then."""
    while len(_made) > after:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the shared tables that were written inside."""
    before = len(_made)
    try:
        yield
    finally:
        release(spark, before)


def _end(spark: SparkSession) -> None:
    with suppress(Exception):  # the session may be gone, and with it the tables' reader
        release(spark)

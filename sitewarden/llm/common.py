"""Shared helpers: table access, scratch tables and word patterns."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six separators between words; every other character belongs to a word.
SPACES = " \t\n\x0b\x0c\r"
#: Lets Spark delete the shuffle files of a write when it is over.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, even inside lambdas.

    A one-element array carries the value into a lambda variable, which the
    optimizer never inlines again.
    """
    return F.transform(F.array(value), body)[0]


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="scratch-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where it is missing, a session whose tasks run in the driver's own process
    gets a folder of its own; on a cluster every machine would write to its own
    disk, so it must be set there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return _own_folder()


_gathered: list[list[Scratch]] = []


@contextlib.contextmanager
def swept():
    """Removes the scratch tables made inside it at its end; what is computed from them must be written by then."""
    _gathered.append([])
    try:
        yield
    finally:
        for scratch in _gathered.pop():
            scratch.drop("")


class Scratch:
    """Tables in the shared folder. They cut lineage and survive the loss of executors.

    Results read them, so they stay until ``drop`` or ``swept`` removes them.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
        if _gathered:
            _gathered[-1].append(self)

    def keep(self, df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
        """``df`` written once, with a codec of Parquet if one is given, and read back."""
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").options(**{"compression": codec} if codec else {}).parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)

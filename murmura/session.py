"""Session defaults, and where lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_scope: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("_scope", default=None)


def build_session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with adaptive execution on; ``settings`` win over the defaults.

    On a cluster leave ``master`` out: it, the checkpoint folder and the
    number of shuffle partitions come from the cluster's own configuration.
    """
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Vector summaries per cluster stay hashed up to that many clusters per
        # task; beyond it Spark sorts the points first.
        "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    builder = SparkSession.builder.appName("murmura")
    if master:
        builder = builder.master(master)
    for key, value in {**defaults, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``, or one set for the session before.

    Only a local session may go without it and gets a temporary folder for as
    long as the process runs; a cluster needs one that all executors share.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
            shared = tempfile.mkdtemp(prefix="murmura-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _remove_at_exit(spark: SparkSession, folder: str) -> None:
    try:
        _remove(spark, folder)
    except (Py4JError, OSError, AttributeError):
        pass  # the JVM has gone before; its folder is the cluster's to clean


def _written(df: DataFrame, by: tuple[str, ...] = ()) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    folder = f"{checkpoint_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(folder)
    scope = _scope.get()
    if scope is None:
        atexit.register(_remove_at_exit, spark, folder)
    else:
        scope.append((spark, folder))
    return spark.read.schema(df.schema).parquet(folder), folder


def shared_folder(spark: SparkSession) -> str:
    """A path in the checkpoint folder, not yet there; what is written to it goes with the process."""
    folder = f"{checkpoint_folder(spark)}/files-{uuid.uuid4().hex}"
    atexit.register(_remove_at_exit, spark, folder)
    return folder


def cut_lineage(df: DataFrame, *by: str) -> DataFrame:
    """``df`` as a table in the checkpoint folder; later reads do not recompute it.

    With columns ``by`` it has a folder for each of their values, so that filters on
    them read only those.  The table is removed at the end of the enclosing ``scratch``, or else with the process.
    """
    return _written(df, by)[0]


class Chain:
    """Cuts the lineage of one table after the other, each made from the one before, which is removed."""

    def __init__(self) -> None:
        self._last: str | None = None

    def cut(self, df: DataFrame) -> DataFrame:
        found, folder = _written(df)
        if self._last is not None:
            _remove(df.sparkSession, self._last)
        self._last, self._spark = folder, df.sparkSession
        return found

    def close(self) -> None:
        """Removes the last table; nothing may read it later."""
        if self._last is not None:
            _remove(self._spark, self._last)
            self._last = None


@contextmanager
def scratch() -> Iterator[None]:
    """Tables written by ``cut_lineage`` inside are removed at the end; nothing may read them later."""
    written: list[tuple[SparkSession, str]] = []
    token = _scope.set(written)
    try:
        yield
    finally:
        _scope.reset(token)
        for spark, folder in written:
            _remove(spark, folder)


def taken(df: DataFrame) -> DataFrame:
    """The few rows of a result by themselves, computed now."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)

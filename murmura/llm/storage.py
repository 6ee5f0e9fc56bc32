"""Tables written to the shared folder between the steps of an operator."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from murmura import session


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors reach.

    A local session without that setting gets a temporary folder, as in
    ``murmura.session.cut_lineage``; a cluster without it fails.
    """
    return f"{session.checkpoint_folder(spark)}/llm-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes ``folder`` through Hadoop's file system, wherever it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, **options: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder; lineage ends there.

    The table lives as long as the Python process of the driver, since
    DataFrames that read it may be used until then.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    df.write.options(**options).parquet(folder)
    atexit.register(_remove_quietly, spark, folder)
    return spark.read.schema(df.schema).parquet(folder)


def _remove_quietly(spark: SparkSession, folder: str) -> None:
    # At the end of the process the session may be gone already; its folder is
    # then the cluster's to clean.
    try:
        remove(spark, folder)
    except Exception:
        pass

"""Written intermediates in the folder that all executors share."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir.  Where that is unset, a temporary folder of this machine
    on a local master (tests), an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.gettempdir()
    return f"{base}/seatwatch-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes the files of tables that written() made.  Nothing that is read later may depend on them."""
    for table in tables:
        for file in table.inputFiles()[:1]:
            _delete(spark, file.rsplit("/", 1)[0])


def release_all(spark: SparkSession) -> None:
    """Deletes every intermediate of this application; its results must have been stored elsewhere."""
    _delete(spark, shared_folder(spark).rsplit("/", 1)[0])


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts lineage, and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/t"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """While it lasts, Arrow batches to Python hold at most ``rows`` rows (for plans that run inside it)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)

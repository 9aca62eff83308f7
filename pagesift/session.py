"""Session construction and the shared scratch location used to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: str = "8", memory: str = "16g", app: str = "pagesift") -> SparkSession:
    """Local session for tests and the bench. A cluster brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor."""
    sc = spark.sparkContext
    if getattr(sc, "_pagesift_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="pagesift-")) / "pagesift_package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    sc.addPyFile(str(archive))
    sc._pagesift_shipped = True


BATCH_ROWS = 2_000
BATCH_BYTES = 4 << 20
"""Rows and bytes that a Python worker is handed at a time; texts are long, and memory is what runs out."""


def limit_batches(spark: SparkSession) -> None:
    """Small Arrow batches, whatever the rows are: what a worker holds does not grow with the rows of its task."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a private temporary one only in local mode where none is configured.

    Temporary ones go when the process ends. What is written below a configured folder stays
    until its owner removes it.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder and not (folder := sc.getCheckpointDir()):
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="pagesift-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint location, one per call."""
    return f"{shared_dir(spark).rstrip('/')}/pagesift/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    This cuts lineage and survives the loss of any executor; unlike a checkpoint the
    result keeps column pruning, filter pushdown and a known size.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def bucketed(df: DataFrame, key: str, name: str, buckets: int | None = None) -> Iterator[DataFrame]:
    """``df`` as a table bucketed and sorted by ``key``, for repeated joins on it.

    Inside the block, joins on the key read the table where it lies instead of
    shuffling it again. One task writes one bucket, so there is one file per bucket;
    the number of shuffle partitions is the default.
    The catalog entry is dropped at the end; results must not depend on the table then.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"pagesift_{name}_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
    writer.option("path", scratch_path(spark, name)).saveAsTable(table)
    try:
        yield spark.table(table)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")

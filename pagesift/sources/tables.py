"""Batch and incremental scans of parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesift import schemas as S
from pagesift.functions.urls import canonical_url


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def corpus(raw: DataFrame) -> DataFrame:
    """Fetched bodies as records: canonical URL and body size beside the body itself."""
    return raw.select("page_id", canonical_url(F.col("url")).alias("url"), F.octet_length("html").cast("bigint").alias("n_bytes"), "html")


def table_stream(spark: SparkSession, folder: str, name: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """Rows of a table as its files arrive: ``name.parquet``, a file or a folder of files."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{folder.rstrip('/')}/{name}[.]parquet")


def page_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    return table_stream(spark, folder, "pages", S.RAW_PAGE, files_per_batch)


def event_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    return table_stream(spark, folder, "events", S.EVENT, files_per_batch)

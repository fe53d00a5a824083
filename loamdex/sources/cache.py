"""The page cache: extracted documents as JSON, partitioned by site, read with a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from loamdex.operators.changes import swap
from loamdex.schemas import EXTRACTED

CACHED = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), *EXTRACTED.fields, T.StructField("site_id", T.LongType())])


def write_cache(documents: DataFrame, path: str) -> None:
    documents.select(*(f.name for f in CACHED.fields)).write.partitionBy("site_id").mode("append").json(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CACHED).json(path)


def drop_cached(spark: SparkSession, path: str, pages: DataFrame) -> DataFrame:
    """The cache without pages (page_id) that were indexed."""
    left = read_cache(spark, path).join(pages.select("page_id"), "page_id", "left_anti").select(*(f.name for f in CACHED.fields))
    return swap(left, path, ["site_id"], "json")

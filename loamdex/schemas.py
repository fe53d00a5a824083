"""Logical schemas and row checks of the engine's relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SITE_STATUSES = ("pending", "indexing", "completed", "failed")
CRAWL_STATUSES = ("pending", "processing", "completed", "failed")


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, optional) for n, t, optional in fields])


L, S, TS = T.LongType(), T.StringType(), T.TimestampNTZType()

SITES = _struct(("id", L, False), ("index_url", S, False), ("base_url", S, False), ("name", S, False), ("version", S, False), ("indexed_date", TS, True), ("status", S, False), ("progress_percent", L, False), ("total_pages", L, False), ("indexed_pages", L, False), ("error_message", S, True), ("created_date", TS, False), ("last_heartbeat", TS, True))
CRAWL_QUEUE = _struct(("id", L, False), ("site_id", L, False), ("url", S, False), ("status", S, False), ("retry_count", L, False), ("error_message", S, True), ("created_date", TS, False))
INDEXED_CHUNKS = _struct(("id", L, False), ("site_id", L, False), ("url", S, False), ("page_title", S, True), ("heading_path", S, True), ("chunk_content", S, False), ("chunk_index", L, False), ("vector_id", S, False), ("indexed_date", TS, False))
HEARTBEAT = _struct(("id", L, False), ("last_heartbeat", TS, True), ("process_id", L, True), ("status", S, False))
VECTORS = _struct(("id", S, False), ("vector", T.ArrayType(T.FloatType(), False), False), ("chunk_id", S, False), ("site_id", L, False), ("page_title", S, False), ("page_url", S, False), ("heading_path", S, True), ("content", S, False), ("token_count", L, False), ("chunk_index", L, False), ("created_at", S, False))
SECTION = _struct(("heading_path", S, False), ("content", S, False), ("heading_level", T.ByteType(), True), ("has_code_blocks", T.BooleanType(), False))
EXTRACTED = _struct(("title", S, False), ("sections", T.ArrayType(SECTION, False), False), ("raw_text", S, False))
CHUNK = _struct(("content", S, False), ("heading_path", S, False), ("chunk_index", L, False), ("token_count", L, False), ("has_code_blocks", T.BooleanType(), False))


def site_problem() -> Column:
    """The first rule that a site breaks, or null."""
    return (
        F.when(F.col("id").isNull() | F.col("index_url").isNull() | F.col("name").isNull() | F.col("version").isNull(), "missing value")
        .when(~F.col("status").isin(*SITE_STATUSES), "unknown status")
        .when(~F.col("progress_percent").between(0, 100), "progress out of range")
        .when((F.col("total_pages") < 0) | (F.col("indexed_pages") < 0), "negative counter")
    )


def queue_problem() -> Column:
    """The first rule that a queue item breaks, or null."""
    return F.when(F.col("id").isNull() | F.col("site_id").isNull() | F.col("url").isNull(), "missing value").when(~F.col("status").isin(*CRAWL_STATUSES), "unknown status").when(F.col("retry_count") < 0, "negative counter")


def vector_problem(width: int, column: str = "vector") -> Column:
    """Why a vector can't be stored in a table of this width, or null. Width is fixed per table; another width is an error, never a new table."""
    return F.when(F.col(column).isNull(), "no vector").when(F.size(column) != width, "another width").when(F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not finite")


def checked_vectors(df: DataFrame, width: int) -> DataFrame:
    """``df``, failing at the first vector that can't be stored."""
    return df.where(F.assert_true(vector_problem(width).isNull(), F.concat(F.lit("vector of "), F.col("id").cast("string"), F.lit(": "), vector_problem(width))).isNull())

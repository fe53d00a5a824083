"""From cached pages to the chunk and vector tables, in one plan; repeated runs add nothing.

Ids are hashes of site, address and position, so a run that failed halfway is simply run again: vectors are
written first, then chunks, and what one store has and the other lacks shows in the reconciliation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamdex.config import ChunkSettings
from loamdex.functions.text import iso_date
from loamdex.operators.catalog import indexing_complete
from loamdex.operators.changes import sparse_update
from loamdex.operators.chunking import chunk_documents, chunk_rows
from loamdex.operators.embed import Embedder, embed_column

CHUNK_COLUMNS = ["id", "site_id", "url", "page_title", "heading_path", "chunk_content", "chunk_index", "vector_id", "indexed_date"]
VECTOR_COLUMNS = ["id", "vector", "chunk_id", "site_id", "page_title", "page_url", "heading_path", "content", "token_count", "chunk_index", "created_at"]


def vector_id() -> Column:
    return F.sha2(F.concat_ws("|", "site_id", "url", "chunk_index"), 256)


def embedded_chunks(pages: DataFrame, embedder: Embedder, settings: ChunkSettings | None = None) -> DataFrame:
    """Chunks with vectors of pages (site_id, url, title, sections, raw_text)."""
    chunked = chunk_documents(pages.select("site_id", "url", "title", "sections", "raw_text"), settings)
    return embed_column(chunk_rows(chunked, "site_id", "url", "title"), embedder).withColumn("vector_id", vector_id())


def as_vectors(rows: DataFrame, now: Column) -> DataFrame:
    return rows.where("vector is not null").select(F.col("vector_id").alias("id"), "vector", F.col("vector_id").alias("chunk_id"), "site_id", F.col("title").alias("page_title"), F.col("url").alias("page_url"), "heading_path", "content", "token_count", "chunk_index", iso_date(now).alias("created_at")).select(*VECTOR_COLUMNS)


def as_chunks(rows: DataFrame, now: Column) -> DataFrame:
    chunk = F.xxhash64("vector_id").bitwiseAND(F.lit(2**63 - 1))
    return rows.where("vector is not null").select(chunk.alias("id"), "site_id", "url", F.col("title").alias("page_title"), "heading_path", F.col("content").alias("chunk_content"), "chunk_index", "vector_id", now.alias("indexed_date")).select(*CHUNK_COLUMNS)


def index_pages(pages: DataFrame, vectors_path: str, chunks_path: str, embedder: Embedder, now: Column, settings: ChunkSettings | None = None) -> None:
    """Appends the pages' vectors, then their chunks. Pages are embedded once: chunks are read back from the vectors just written."""
    spark = pages.sparkSession
    stamp = iso_date(now)
    rows = embedded_chunks(pages, embedder, settings)
    as_vectors(rows, now).write.partitionBy("site_id").mode("append").parquet(vectors_path)
    fresh = spark.read.parquet(vectors_path).where(F.col("created_at") == stamp).join(pages.select(F.col("site_id"), F.col("url").alias("page_url")).distinct(), ["site_id", "page_url"], "left_semi")
    chunk = F.xxhash64("chunk_id").bitwiseAND(F.lit(2**63 - 1))
    stored = fresh.select(chunk.alias("id"), F.col("site_id").cast("long").alias("site_id"), F.col("page_url").alias("url"), "page_title", "heading_path", F.col("content").alias("chunk_content"), "chunk_index", F.col("chunk_id").alias("vector_id"), now.alias("indexed_date"))
    stored.write.mode("append").parquet(chunks_path)


def finished_sites(sites: DataFrame, queue: DataFrame, chunks: DataFrame, now: Column) -> DataFrame:
    """Sites with nothing left to crawl or index become completed."""
    done = indexing_complete(queue, chunks).where("is_complete").select(F.col("site_id").alias("id"), F.lit("completed").alias("status"), F.lit(100).cast("long").alias("progress_percent"), now.alias("indexed_date"))
    return sparse_update(sites, done)

"""Reconciliation of the chunk catalogue with the vector table: one full outer join, everything else is an aggregate of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compared(sites: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """vector_id, site_id and state (present, missing: a chunk of a completed site without vector, orphaned: a vector without chunk) of every id."""
    done = sites.where(F.col("status") == "completed").select(F.col("id").alias("site_id"))
    c = chunks.where("vector_id is not null").join(done, "site_id", "left_semi").groupBy("vector_id").agg(F.max("site_id").alias("_chunk_site"), F.lit(1).alias("_c"))
    v = vectors.where("id is not null").groupBy(F.col("id").alias("vector_id")).agg(F.max("site_id").alias("_vector_site"), F.lit(1).alias("_v"))
    state = F.when(F.col("_v").isNull(), "missing").when(F.col("_c").isNull(), "orphaned").otherwise("present")
    return c.join(v, "vector_id", "full_outer").select("vector_id", F.coalesce(F.col("_chunk_site").cast("string"), F.col("_vector_site").cast("string")).alias("site_id"), state.alias("state"))


def missing_vectors(state: DataFrame) -> DataFrame:
    return state.where("state = 'missing'").select("vector_id", "site_id")


def orphaned_vectors(state: DataFrame) -> DataFrame:
    return state.where("state = 'orphaned'").select("vector_id", "site_id")


def consistency_by_site(state: DataFrame) -> DataFrame:
    """Counts of every site that has something missing or orphaned."""
    by = state.groupBy("site_id").agg(F.count_if(F.col("state") != "orphaned").alias("chunks"), *(F.count_if(F.col("state") == s).alias(s) for s in ("present", "missing", "orphaned")))
    return by.where((F.col("missing") > 0) | (F.col("orphaned") > 0))


def consistency_totals(state: DataFrame) -> DataFrame:
    """Sizes of both stores, of both differences, and whether the stores agree."""
    by = state.agg(F.count_if(F.col("state") != "orphaned").alias("chunks"), F.count_if(F.col("state") != "missing").alias("vectors"), F.count_if(F.col("state") == "missing").alias("missing"), F.count_if(F.col("state") == "orphaned").alias("orphaned"))
    return by.withColumn("issues", F.col("missing") + F.col("orphaned")).withColumn("is_consistent", F.col("issues") == 0)


def summary(totals: DataFrame) -> DataFrame:
    """One line of text."""
    fine = F.format_string("consistent: %d chunks, %d vectors", "chunks", "vectors")
    bad = F.format_string("%d issues: %d chunks without vector, %d vectors without chunk (%d chunks, %d vectors)", "issues", "missing", "orphaned", "chunks", "vectors")
    return totals.select(F.when(F.col("is_consistent"), fine).otherwise(bad).alias("summary"))


def without_orphans(vectors: DataFrame, state: DataFrame) -> DataFrame:
    """The vector table without vectors that have no chunk."""
    return vectors.join(orphaned_vectors(state).select(F.col("vector_id").alias("id")), "id", "left_anti")


def chunks_to_embed(chunks: DataFrame, state: DataFrame) -> DataFrame:
    """Chunks whose vector is missing."""
    return chunks.join(missing_vectors(state).select("vector_id"), "vector_id", "left_semi")

"""Exact and approximate top-k search over stored vectors, with filters and site data.

The distance is squared Euclidean, the score 1 minus it; ties go to the smaller id. One query is a literal in the
plan (no join at all); many queries are scored block by block with one matrix product per batch, and only what may
still be among the k best leaves it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def squared_distance(a: Column, b: Column) -> Column:
    """In doubles, summed from the first coordinate on."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def score(distance: Column) -> Column:
    """1 minus the distance; a missing distance counts as 0."""
    return F.lit(1.0) - F.coalesce(distance, F.lit(0.0))


def top_k(vectors: DataFrame, query: Sequence[float], k: int = 10, where: Column | None = None, key: str = "id", vector: str = "vector") -> DataFrame:
    """The k nearest rows to one query with distance and score. ``where`` filters before any distance is computed; k below 1 is 1; another width is an error."""
    literal = F.array(*(F.lit(float(x)) for x in query))
    rows = vectors if where is None else vectors.where(where)
    fits = F.assert_true(F.size(vector) == len(query), F.lit("the query has another width than the stored vectors"))
    scored = rows.where(F.col(vector).isNotNull()).where(fits.isNull()).withColumn("distance", squared_distance(F.col(vector), literal)).drop(vector)
    return scored.orderBy("distance", key).limit(max(1, k)).withColumn("score", score(F.col("distance")))


#: Distances that one step holds at once.
TILE = 1 << 22


class _Nearest:
    """The k nearest rows of each of a block of queries; rows come batch by batch, and only those pass that may still be among the k."""

    def __init__(self, queries: np.ndarray, k: int):
        self.q, self.k = queries, max(1, k)
        self.norms = (queries * queries).sum(axis=1)
        self.best = np.full((len(queries), self.k), np.inf)  # the smallest distances so far

    def add(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of queries and rows, and their distances."""
        norms, found = (x * x).sum(axis=1), []
        step = max(1, TILE // max(1, len(x)))
        for s in range(0, len(self.q), step):
            q, best = self.q[s : s + step], self.best[s : s + step]
            d = self.norms[s : s + step, None] - 2 * (q @ x.T) + norms
            m = min(self.k, len(x))
            floor = np.minimum(np.partition(d, m - 1, axis=1)[:, m - 1] if m == self.k else np.inf, best[:, -1])
            r, c = np.nonzero(d <= (floor + 1e-9 * (1 + self.norms[s : s + step]))[:, None])
            exact = ((q[r] - x[c]) ** 2).sum(axis=1)
            order = np.lexsort((exact, r))
            r, c, exact = r[order], c[order], exact[order]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            top = place < self.k
            fresh = np.full((len(q), self.k), np.inf)
            fresh[r[top], place[top]] = exact[top]
            self.best[s : s + step] = np.sort(np.concatenate([best, fresh], axis=1), axis=1)[:, : self.k]
            found.append((r + s, c, exact))
        return tuple(np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _matrix(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def batch_top_k(queries: DataFrame, vectors: DataFrame, k: int = 10, query_key: str = "query_id", key: str = "id", vector: str = "vector", most_queries: int = 20_000, part_rows: int = 100_000) -> DataFrame:
    """query_key, key, distance and rank of the k nearest rows of every query, exactly.

    Up to ``most_queries`` queries go to the executors as one block, and the vectors are scanned once. More are cut into
    blocks, the vectors into parts of ``part_rows``, and each block meets each part in a task of its own."""
    q_type, v_type = queries.schema[query_key].dataType, vectors.schema[key].dataType
    out = T.StructType([T.StructField(query_key, q_type), T.StructField(key, v_type), T.StructField("distance", T.DoubleType())])
    blocks = queries.where(F.col(vector).isNotNull()).select(F.col(query_key).alias("q"), F.col(vector).alias("v"))
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).alias("v"))
    n = blocks.count()
    if n <= most_queries:
        few = blocks.collect()
        shared = vectors.sparkSession.sparkContext.broadcast(([r.q for r in few], np.array([r.v for r in few], np.float64).reshape(len(few), -1 if few else 0)))

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            ids, nearest = pa.array(ids, to_arrow_type(q_type)), _Nearest(q, k)
            for b in batches:
                if b.num_rows and len(ids):
                    r, c, d = nearest.add(_matrix(b.column("v"), b.num_rows))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(r)), b.column("k").take(pa.array(c)), pa.array(d)], [query_key, key, "distance"])

        met = rows.mapInArrow(best, out)
    else:
        block, part = -(-n // most_queries), max(1, -(-rows.count() // part_rows))
        each = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
        left = blocks.select(F.pmod(F.xxhash64("q"), F.lit(block)).cast("int").alias("block"), each(part).alias("part"), "q", F.lit(None).cast(v_type).alias("k"), "v")
        right = rows.select(each(block).alias("block"), F.pmod(F.xxhash64("k"), F.lit(part)).cast("int").alias("part"), F.lit(None).cast(q_type).alias("q"), "k", "v")

        def meet(group: pa.Table) -> pa.Table:
            of = group.filter(pc.is_null(group.column("k")))
            ids, x = of.column("q").combine_chunks(), group.filter(pc.is_valid(group.column("k")))
            found: list[pa.Table] = []
            if len(ids) and x.num_rows:
                nearest = _Nearest(_matrix(of.column("v"), len(ids)), k)
                for s in range(0, x.num_rows, 10_000):
                    b = x.slice(s, 10_000)
                    r, c, d = nearest.add(_matrix(b.column("v"), b.num_rows))
                    found.append(pa.table({query_key: ids.take(pa.array(r)), key: b.column("k").combine_chunks().take(pa.array(c)), "distance": pa.array(d)}))
            types = pa.schema([(query_key, to_arrow_type(q_type)), (key, to_arrow_type(v_type)), ("distance", pa.float64())])
            return pa.concat_tables(found) if found else types.empty_table()

        met = left.unionByName(right).groupBy("block", "part").applyInArrow(meet, out)
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy("distance", key))
    return met.withColumn("rank", rank).where(F.col("rank") <= max(1, k))


@dataclass(frozen=True)
class ApproximateIndex:
    """A stored index of vectors in lists around centres: a query meets the rows of the lists whose centres are nearest to it.

    Centres are fitted on at most ``SAMPLE`` rows, taken by a hash of their keys; every row is then in the list of its
    nearest centre, lists are folders of the table, and the rows of the lists asked are ranked by their exact distance."""

    path: str
    centres: np.ndarray
    key: str
    vector: str

    SAMPLE: ClassVar[int] = 20_000

    @staticmethod
    def build(vectors: DataFrame, path: str, key: str = "id", vector: str = "vector", lists: int | None = None, rounds: int = 8) -> ApproximateIndex:
        """Writes the rows below ``path``; ``lists`` is the square root of their number unless given, at most 4096."""
        rows = vectors.where(F.col(vector).isNotNull())
        n = rows.count()
        share = min(1.0, ApproximateIndex.SAMPLE / max(1, n))
        taken = rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 40)) < int(share * (1 << 40))).orderBy(F.xxhash64(key)).limit(ApproximateIndex.SAMPLE).select(vector).collect()
        x = np.array([r[0] for r in taken], np.float64).reshape(len(taken), -1 if taken else 0)
        lists = min(lists or min(4096, round(n**0.5)), len(x)) or 1
        centres = x[:: max(1, len(x) // lists)][:lists].copy()
        for _ in range(rounds if len(x) else 0):
            at = _nearest_centre(x, centres)
            counts = np.bincount(at, minlength=len(centres))
            sums = np.zeros_like(centres)
            np.add.at(sums, at, x)
            centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
        index = ApproximateIndex(path, centres, key, vector)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    lists = pa.array(_nearest_centre(_matrix(b.column(vector), b.num_rows), centres).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([*b.columns, lists], [*b.schema.names, "list"])

        listed = rows.mapInArrow(assign, T.StructType([*rows.schema.fields, T.StructField("list", T.IntegerType())]))
        listed.repartition("list").write.partitionBy("list").mode("overwrite").parquet(path)
        return index

    def search(self, queries: DataFrame, k: int = 10, query_key: str = "query_id", probes: float = 0.7) -> DataFrame:
        """query_key, the columns of the rows but for their vector, distance and rank of the k nearest rows of each query in the nearest lists, a share ``probes`` of all (at least one). Vectors without structure need most lists, those in clusters few."""
        n = max(1, round(probes * len(self.centres)))
        centres = self.centres

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows and len(centres):
                    x = _matrix(b.column(self.vector), b.num_rows)
                    d = (centres * centres).sum(axis=1) - 2 * (x @ centres.T)
                    lists = np.argpartition(d, n - 1, axis=1)[:, :n].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * n), pa.array(lists.ravel()))], [*b.schema.names, "lists"])

        asked = queries.where(F.col(self.vector).isNotNull()).select(query_key, self.vector)
        asked = asked.mapInArrow(ask, T.StructType([*asked.schema.fields, T.StructField("lists", T.ArrayType(T.IntegerType()))]))
        asked = asked.select(query_key, F.col(self.vector).alias("_q"), F.explode("lists").alias("list"))
        met = queries.sparkSession.read.parquet(self.path).join(asked, "list").drop("list")
        scored = met.withColumn("distance", squared_distance(F.col(self.vector), F.col("_q"))).drop(self.vector, "_q")
        rank = F.row_number().over(Window.partitionBy(query_key).orderBy("distance", self.key))
        return scored.withColumn("rank", rank).where(F.col("rank") <= max(1, k))


def _nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    norms = (centres * centres).sum(axis=1)
    return np.concatenate([(norms - 2 * (x[s : s + 4096] @ centres.T)).argmin(axis=1) for s in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


def enriched(results: DataFrame, sites: DataFrame) -> DataFrame:
    """Search results with the name and version of their site; unknown sites and missing headings have defaults."""
    names = sites.select(F.col("id").alias("site_id"), F.col("name").alias("site_name"), F.col("version").alias("site_version"))
    return results.join(names, "site_id", "left").select(
        "content",
        F.col("page_url").alias("url"),
        "page_title",
        F.coalesce("heading_path", F.lit("N/A")).alias("heading_path"),
        F.coalesce("site_name", F.lit("Unknown Site")).alias("site_name"),
        F.coalesce("site_version", F.lit("unknown")).alias("site_version"),
        F.col("score").alias("relevance_score"),
    )

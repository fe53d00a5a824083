"""The k most similar vectors for every vector, by cross-polytope hashing.

Unit vectors are rotated by fast Hadamard pseudo-rotations (three rounds of sign flips and a Walsh-Hadamard
transform) and assigned to their nearest signed axes: a table's bucket is an axis, and a vector enters the
buckets of its ``probes`` nearest axes in each of ``tables`` rotations. Within a bucket all similarities come
from one matrix product; a vector passes on its k best of each bucket, and a pair that meets in several buckets
is passed on by the first. Similarities there are those of 16-bit coordinates (error below ``SLACK``); pairs for
which that could change the result, at the threshold or at rank k, are ranked by their full vectors.

Vectors with equal codes are one class and hashed once, so a vector that a third of all records share costs one
row; the k members with the smallest ids stand for their class. A bucket of more than ``bucket_rows`` classes is
cut into parts, and every two parts meet in a task of their own: no pair of a bucket is left out, so the recall does
not depend on the number of vectors. The work within a full bucket grows with the square of its classes.

Parameters as shipped: 2 tables, 4 probes; measured recall of the pairs of ``p1_found`` is in the README.

Defined cases: null, empty, zero, not finite vectors and those of another width are no records; norms don't
matter; rows repeated with the same id are one record; ties go to the smaller id; an empty table gives no rows;
null ids are dropped; only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamdex.plans.scratch import materialize
from loamdex.sources.tables import table

SLACK = 1e-5
#: Classes up to which the list of those with undecided pairs is broadcast (about 16 MB); beyond, the vectors are shuffled to it.
BROADCAST_CLASSES = 250_000


@lru_cache(maxsize=64)
def _signs(width: int, seed: int) -> np.ndarray:
    return np.random.default_rng([width, seed]).choice(np.array([-1, 1], np.float32), (3, width))


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """Rows padded to a power of two and rotated pseudo-randomly; lengths grow by the same factor."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), width), np.float32)
    y[:, : x.shape[1]] = x
    for signs in _signs(width, seed):
        y *= signs
        step = 1
        while step < width:
            y = y.reshape(len(x), -1, 2, step)
            y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), width)
            step *= 2
    return y


def nearest_axes(x: np.ndarray, seed: int, probes: int) -> np.ndarray:
    """Codes of the ``probes`` signed axes nearest to each rotated row, nearest first."""
    y = rotate(x, seed)
    size = np.abs(y)
    top = np.argpartition(-size, probes - 1, axis=1)[:, :probes]
    top = np.take_along_axis(top, np.argsort(-np.take_along_axis(size, top, 1), axis=1, kind="stable"), 1)
    return top * 2 + (np.take_along_axis(y, top, 1) > 0)


def _units(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the usable vectors, and these at length 1."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    at = np.flatnonzero(sizes == width)
    x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    with np.errstate(all="ignore"):
        x = x / np.abs(x).max(axis=1, keepdims=True, initial=0)
        x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    good = np.isfinite(x).all(axis=1)
    return at[good], x[good]


def _rows(codes: list[bytes], width: int) -> np.ndarray:
    x = np.frombuffer(b"".join(codes), np.int16).reshape(-1, width).astype(np.float32)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def unit_codes(df: DataFrame, id_col: str, vector_col: str, width: int) -> DataFrame:
    """id, hash (of the vector as it is stored), key (64 bits of the class) and code (16-bit coordinates) of every usable record."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _units(batch.column("vector"), width)
            q = np.rint(x / np.abs(x).max(axis=1, keepdims=True, initial=1e-30) * 32767).astype(np.int16)
            codes = [row.tobytes() for row in q]
            keys = np.array([xxhash.xxh64_intdigest(c) for c in codes], np.uint64).astype(np.int64)
            kept = [batch.column(n).take(pa.array(at)) for n in ("id", "hash")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(keys, pa.int64()), pa.array(codes, pa.binary())], ["id", "hash", "key", "code"])

    return _vectors(df, id_col, vector_col, width).mapInArrow(encode, "id string, hash long, key long, code binary")


def _vectors(df: DataFrame, id_col: str, vector_col: str, width: int) -> DataFrame:
    rows = df.where(F.col(id_col).isNotNull() & (F.size(vector_col) == width))
    return rows.select(F.col(id_col).cast("string").alias("id"), F.xxhash64(vector_col).alias("hash"), F.col(vector_col).alias("vector"))


def _classes(units: DataFrame, width: int, tables: int, probes: int) -> DataFrame:
    """key, one record of the class (id, hash), its buckets and packed (key, axes of all tables, code)."""

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, keys = batch.column("code").to_pylist(), batch.column("key").to_numpy()
            if not codes:
                continue
            x = _rows(codes, width)
            axes = np.stack([nearest_axes(x, t, probes) for t in range(tables)], 1).astype(np.uint16)
            packed = pa.array([k + a.tobytes() + c for k, a, c in zip((k.tobytes() for k in keys), axes, codes, strict=True)], pa.binary())
            buckets = (axes.astype(np.int64) + (np.arange(tables) << 16)[:, None]).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * tables * probes), pa.array(buckets))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("key", "id", "hash")), lists, packed], ["key", "id", "hash", "buckets", "packed"])

    one = units.groupBy("key").agg(F.first("code").alias("code"), F.min(F.struct("id", "hash")).alias("r")).select("key", "r.id", "r.hash", "code")
    return one.mapInArrow(enter, "key long, id string, hash long, buckets array<long>, packed binary")


def _buckets(classes: DataFrame, bucket_rows: int) -> DataFrame:
    """bucket, lo, hi, part, packed. (bucket, lo, hi) is a task in which two parts of a bucket meet."""
    full = classes.select(F.explode("buckets").alias("bucket")).groupBy("bucket").count().where(F.col("count") > bucket_rows).select("bucket", F.ceil(F.col("count") / bucket_rows).alias("parts"))
    full = materialize(full, "full-buckets")
    none = F.lit(0).cast("long")
    entries = classes.select(F.explode("buckets").alias("bucket"), "packed")
    if full.isEmpty():
        return entries.select("bucket", none.alias("lo"), none.alias("hi"), none.alias("part"), "packed")
    # There are at most as many full buckets as signed axes in all tables.
    cut = entries.join(F.broadcast(full), "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("packed"), F.col("parts"))).withColumn("other", F.explode(F.sequence(none, F.col("parts") - 1)))
    return cut.select("bucket", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "packed")


def _bucket_best(width: int, tables: int, probes: int, k: int, least: float):
    """Of each row of a bucket, or of one of its parts, the k best others there, or in the part it meets, with similarity of at least ``least``."""
    head = 8 + 2 * tables * probes

    def best(group: pa.Table) -> pa.Table:
        packed = group.column("packed").to_pylist()
        keys = np.frombuffer(b"".join(b[:8] for b in packed), np.int64)
        axes = np.frombuffer(b"".join(b[8:head] for b in packed), np.uint16).reshape(-1, tables, probes)
        x = _rows([b[head:] for b in packed], width)
        bucket, lo, hi = (group.column(n)[0].as_py() for n in ("bucket", "lo", "hi"))
        this, axis = bucket >> 16, bucket & 0xFFFF
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def meet(rows: np.ndarray, others: np.ndarray) -> None:
            y, n = x[others], len(others)
            for s in range(0, len(rows) if n else 0, 1024):
                sims = x[rows[s : s + 1024]] @ y.T
                if lo == hi:
                    sims[np.arange(len(sims)), np.arange(s, s + len(sims))] = -2
                floor = np.full(len(sims), least, np.float32)
                if n > k:
                    floor = np.maximum(floor, np.partition(sims, n - k, axis=1)[:, n - k] - np.float32(SLACK))
                r, c = np.nonzero(sims >= floor[:, None])
                v = sims[r, c]
                r, c = rows[r + s], others[c]
                if len(r):
                    first = np.ones(len(r), bool)
                    for t in range(this):
                        first &= ~(axes[r, t][:, :, None] == axes[c, t][:, None, :]).any(axis=(1, 2))
                    a, b = axes[r, this], axes[c, this]
                    first &= ~((a[:, :, None] == b[:, None, :]) & (a[:, :, None] < axis)).any(axis=(1, 2))
                    r, c, v = r[first], c[first], v[first]
                out.append((keys[r], keys[c], v))

        part = group.column("part").to_numpy()
        one, two = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
        meet(one, two)
        if lo != hi:
            meet(two, one)
        a, b, v = (np.concatenate(z) for z in zip(*out, strict=True)) if out else (keys[:0], keys[:0], np.zeros(0))
        return pa.table({"a": a, "b": b, "sim": v.astype(np.float32)})

    return best


def _exact(pairs: DataFrame, classes: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
    """a, b, sim of undecided pairs of classes, by the full vector of one record of each."""
    wanted = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct().withColumnRenamed("a", "key")
    wanted = materialize(classes.select("key", "id", "hash").join(wanted, "key", "left_semi"), "asked-classes")
    few = wanted.count() <= BROADCAST_CLASSES
    found = vectors.join(F.broadcast(wanted) if few else wanted, ["id", "hash"]).groupBy("key").agg(F.first("vector").alias("vector"))
    found = materialize(found, "asked-vectors")

    def cosine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (_, x), (_, y) = (_units(batch.column(n), width) for n in ("va", "vb"))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array((x * y).sum(axis=1))], ["a", "b", "sim"])

    left = pairs.join(found.select(F.col("key").alias("a"), F.col("vector").alias("va")), "a")
    both = left.join(found.select(F.col("key").alias("b"), F.col("vector").alias("vb")), "b")
    return both.select("a", "b", "va", "vb").mapInArrow(cosine, "a long, b long, sim double")


def nearest_pairs(df: DataFrame, id_col: str = "id", vector_col: str = "vector", width: int = 96, k: int = 8, least: float = 0.7, tables: int = 2, probes: int = 4, bucket_rows: int = 8192) -> DataFrame:
    """id_a < id_b of all pairs found with cosine of at least ``least`` of which one is among the k most similar of the other."""
    units = materialize(unit_codes(df, id_col, vector_col, width), "unit-codes")
    classes = materialize(_classes(units, width, tables, probes), "classes")
    entries = _buckets(classes, bucket_rows)
    met = entries.groupBy("bucket", "lo", "hi").applyInArrow(_bucket_best(width, tables, probes, k, least - SLACK), "a long, b long, sim float")
    # A pair of classes is passed on once, by the first bucket that both are in.
    near = met.groupBy("a").agg(F.sort_array(F.collect_list(F.struct((-F.col("sim")).alias("far"), "b"))).alias("near"))
    near = materialize(near.withColumn("edge", F.coalesce(F.try_element_at("near", F.lit(k))["far"], F.lit(9.0))), "neighbours")

    # Undecided: within the slack of rank k while more than k are, or within the slack of the threshold.
    slack = F.lit(2 * SLACK)
    inside = lambda y: y["far"] < F.col("edge") - slack
    zone = lambda y: F.abs(y["far"] - F.col("edge")) <= slack
    limit = lambda y: F.abs(y["far"] + F.lit(float(least))) <= slack
    doubt = (F.size(F.filter("near", lambda y: inside(y) | zone(y))) > k) | F.exists("near", limit)
    sure = near.where(~doubt).select("a", F.slice("near", 1, k).alias("near"))
    open_ = near.where(doubt)
    asked = materialize(open_.select("a", F.explode(F.filter("near", lambda y: zone(y) | limit(y))).alias("y")).select("a", F.col("y.b").alias("b")).distinct(), "undecided")
    full = _exact(asked, classes, _vectors(df, id_col, vector_col, width), width).select("a", "b", F.col("sim").alias("exact"))
    decided = open_.select("a", F.explode("near").alias("y")).select("a", F.col("y.b").alias("b"), F.col("y.far").cast("double").alias("far")).join(full, ["a", "b"], "left")
    decided = decided.withColumn("far", F.coalesce(-F.col("exact"), "far")).where(F.col("far") <= -least)
    decided = decided.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct(F.col("far").cast("float").alias("far"), "b"))), 1, k).alias("near"))
    lists = sure.unionByName(decided)

    return _expand(lists, units.select("id", "key").distinct(), k)


def _expand(lists: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """Pairs of records from lists of classes (a, near: nearest first). Each member of a class has the other members before all else, in order of id."""
    sizes = members.groupBy("key").agg(F.count("*").alias("size"))
    links = lists.select(F.col("a"), F.posexplode("near").alias("pos", "y")).select("a", F.col("y.b").alias("b"), "pos")
    several = sizes.where("size > 1")
    # Where all classes of a list are single, each of its links takes the one member; else sizes decide how many.
    b_size = links.join(several.withColumnRenamed("key", "b").withColumnRenamed("size", "nb"), "b", "left")
    both = b_size.join(several.withColumnRenamed("key", "a").withColumnRenamed("size", "na"), "a", "left").fillna(1, ["na", "nb"])
    one_way = both.groupBy("a", "na").agg(F.sort_array(F.collect_list(F.struct("pos", "b", "nb"))).alias("all")).select(
        "a",
        "na",
        F.inline(
            F.aggregate(
                "all",
                F.struct((F.col("na") - 1).alias("used"), F.array().cast("array<struct<b:bigint,take:bigint>>").alias("out")),
                lambda s, y: F.struct(
                    (s["used"] + y["nb"]).alias("used"),
                    F.when(s["used"] >= k, s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(y["b"].alias("b"), F.least(y["nb"], F.lit(k) - s["used"]).alias("take"))))).alias("out"),
                ),
            )["out"]
        ),
    )
    lo_first = F.col("a") < F.col("b")
    pairs = one_way.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.max(F.when(lo_first, F.col("take"))).alias("of_hi"), F.max(F.when(~lo_first, F.col("take"))).alias("of_lo"))

    single = members.join(several.select("key"), "key", "left_anti").select("key", "id", F.lit(1).alias("rank"))
    shared = members.join(several.select("key"), "key", "left_semi").select("key", "id")
    heads = _heads(shared, k + 1)
    # Ranks beyond the heads don't matter; they all count as the one after.
    grouped = shared.join(heads, ["key", "id"], "left").select("key", "id", F.coalesce("rank", F.lit(k + 2)).alias("rank"))
    # A class of more than k members lists none of another, and no other lists more than its first k: in links the rest has no part.
    ranked = single.unionByName(heads.where(F.col("rank") <= k).select("key", "id", "rank"))
    joined = pairs.join(ranked.select(F.col("key").alias("lo"), F.col("id").alias("x"), F.col("rank").alias("rx")), "lo")
    first_only = F.col("of_hi").isNotNull() | (F.col("rx") <= F.col("of_lo"))
    joined = joined.where(first_only).join(ranked.select(F.col("key").alias("hi"), F.col("id").alias("y"), F.col("rank").alias("ry")), "hi")
    across = joined.where((F.col("ry") <= F.col("of_hi")) | (F.col("rx") <= F.col("of_lo"))).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    # The heads of a class go to every part of it.
    parts = heads.select("key", F.col("id").alias("h"), F.col("rank").alias("rh"), F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    within = grouped.withColumn("salt", _salt()).join(parts, ["key", "salt"]).where((F.col("id") > F.col("h")) & (F.col("rh") <= F.when(F.col("rank") <= k, k + 1).otherwise(k)))
    return across.unionByName(within.select(F.col("h").alias("id_a"), F.col("id").alias("id_b")))


_SALTS = 16


def _salt():
    return F.pmod(F.xxhash64("id"), F.lit(_SALTS)).cast("int")


def _heads(shared: DataFrame, n: int) -> DataFrame:
    """key, id, rank of the n smallest ids of each class: first of each part of a class, then of what the parts gave."""
    first = F.row_number().over(Window.partitionBy("key", "salt").orderBy("id"))
    last = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    parts = shared.withColumn("salt", _salt()).withColumn("rank", first).where(F.col("rank") <= n)
    return parts.select("key", "id").withColumn("rank", last).where(F.col("rank") <= n)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with cosine of at least 0.70 of which one is among the 8 most similar records of the other."""
    return nearest_pairs(table(spark, sf_dir, "embedding_records"))


QUERIES = {"p1_found": p1_found}
ORACLES: dict[str, str] = {}

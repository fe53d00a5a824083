"""Near-duplicate records with small edits: banded MinHash candidates, sequential Bayesian verification, exact check.

Words are runs of a-z and 0-9 in the lower-cased text; a record is the set of its distinct runs of ``shingle``
consecutive words. Records with equal sets are one class. A class enters one bucket per band of its MinHash
signature; classes that share a bucket are candidates. A candidate pair compares its 8-bit signature in batches:
after each batch the pair is dropped if the posterior probability (uniform prior on the similarity) that it
reaches the threshold is below ``miss``. Survivors are compared by their whole shingle sets.

A text that a third of all records share is one class before it enters any bucket. Buckets are counted with partial
sums and joined, not collected; a hot bucket of different texts is cut into parts that meet two by two in tasks of
their own, and a pair that meets in several buckets is verified once. Where pairs of records are asked for, the
members of a class of more than ``PART_ROWS`` are joined in parts.

``near_duplicate_groups`` returns one row per record with its class and component and its number of links to
other texts, ``near_duplicate_pairs`` all pairs. Parameters as shipped for p2: three words, similarity of 0.6,
32 bands of 3, which miss 0.04 % of the pairs at exactly 0.6 and 0.003 % at 0.65; the default elsewhere is five
words and 0.8.

Defined cases: null texts and those of fewer than ``least_words`` words are no records; null ids are dropped;
rows repeated with one id are one record; an empty table gives no rows; only the two named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamdex.llm.batches import by_size
from loamdex.plans.scratch import materialize
from loamdex.sources.tables import table

_WORD = re.compile(r"[a-z0-9]+")
#: Bytes kept of a shingle's hash in the exact sets: two shingles of a pair are confused with probability 1e-12.
_KEPT = 5
#: Members of a class that are joined in one part; bytes of texts or sets that one Python step takes at once.
PART_ROWS, STEP_BYTES = 4096, 4 << 20


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: list[str | None], shingle: int, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the records among the texts; their distinct shingle hashes end to end, sorted; where each set starts."""
    known: dict[str, int] = {}
    at, words, ends = [], [], [0]
    for k, text in enumerate(texts):
        found = _WORD.findall(text.lower()) if text else []
        if len(found) >= max(least_words, shingle):
            at.append(k)
            for w in found:
                h = known.get(w)
                if h is None:
                    h = known[w] = xxhash.xxh64_intdigest(w)
                words.append(h)
            ends.append(len(words))
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    w, e = np.array(words, np.uint64), np.array(ends)
    h = np.zeros(len(w) - shingle + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(shingle):
            h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - shingle + 1 + k])
    doc = np.repeat(np.arange(len(at)), np.diff(e))
    inside = np.arange(len(h)) <= e[doc[: len(h)] + 1] - shingle
    d, h = doc[: len(h)][inside], h[inside]
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    d, h = d[new], h[new]
    return np.array(at), h, np.searchsorted(d, np.arange(len(at)))


def signatures(h: np.ndarray, starts: np.ndarray, size: int, seed: int) -> np.ndarray:
    """MinHash values, one row per set."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 63, size, np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, size, np.uint64)
    out = np.empty((len(starts), size), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(size):
            out[:, k] = np.minimum.reduceat(((h * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def keep_from(threshold: float, batch: int, size: int, miss: float) -> list[int]:
    """After each batch, the fewest equal 8-bit values with which P(similarity >= threshold) is still at least ``miss``.

    With m of n equal and a uniform prior the posterior of the chance of equality is Beta(m + 1, n - m + 1), whose
    upper tail is a binomial sum; the chance of equality is s + (1 - s) / 256."""
    p = threshold + (1 - threshold) / 256
    least = []
    for n in range(batch, size + 1, batch):
        tail = lambda m, n=n: sum(comb(n + 1, k) * p**k * (1 - p) ** (n + 1 - k) for k in range(m + 1))
        least.append(next((m for m in range(n + 1) if tail(m) >= miss), n))
    return least


def _features(df: DataFrame, id_col: str, text_col: str, shingle: int, least_words: int, bands: int, rows: int, size: int) -> DataFrame:
    """id, fp (class: hash of the set), bands, sig, set of every record."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in by_size(b, "text", STEP_BYTES)):
            at, h, starts = shingle_sets(batch.column("text").to_pylist(), shingle, least_words)
            if not len(at):
                continue
            banded = signatures(h, starts, bands * rows, 1).astype(np.uint64).reshape(len(at), bands, rows)
            with np.errstate(over="ignore"):
                key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(at), bands))
                for r in range(rows):
                    key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + banded[:, :, r] + np.uint64(1))
            sig = (signatures(h, starts, size, 2) & np.uint32(0xFF)).astype(np.uint8)
            kept = h.view(np.uint8).reshape(-1, 8)[:, :_KEPT]
            ends = [*starts[1:], len(h)]
            sets = [kept[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]
            fps = [xxhash.xxh128_digest(h[s:e].tobytes()) for s, e in zip(starts, ends, strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * bands), pa.array(key.astype(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), pa.array(fps, pa.binary()), lists, pa.array([s.tobytes() for s in sig], pa.binary()), pa.array(sets, pa.binary())], ["id", "fp", "bands", "sig", "set"])

    rows_ = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows_.mapInArrow(build, "id string, fp binary, bands array<long>, sig binary, set binary")


def similarities(xs: list[bytes], ys: list[bytes]) -> np.ndarray:
    """Shared shingles over all shingles of each pair of sets, all pairs at once."""
    found = []
    for side, sets in enumerate((xs, ys)):
        wide = np.zeros((sum(map(len, sets)) // _KEPT, 8), np.uint8)
        wide[:, :_KEPT] = np.frombuffer(b"".join(sets), np.uint8).reshape(-1, _KEPT)
        pair = np.repeat(np.arange(len(sets), dtype=np.uint64), [len(x) // _KEPT for x in sets])
        found.append((pair << np.uint64(8 * _KEPT + 1)) | (wide.view("<u8").ravel() << np.uint64(1)) | np.uint64(side))
    all_ = np.unique(np.concatenate(found))
    pair = (all_ >> np.uint64(8 * _KEPT + 1)).astype(np.int64)
    both = np.bincount(pair[:-1][all_[1:] >> np.uint64(1) == all_[:-1] >> np.uint64(1)], minlength=len(xs))
    return both / (np.bincount(pair, minlength=len(xs)) - both)


def _verified(candidates: DataFrame, sigs: DataFrame, sets: DataFrame, threshold: float, batch: int, size: int, miss: float) -> DataFrame:
    least = keep_from(threshold, batch, size, miss)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(n).to_pylist()), np.uint8).reshape(-1, size) for n in ("sig_a", "sig_b"))
            alive, equal = np.arange(b.num_rows), np.zeros(b.num_rows, np.int64)
            for n, m in enumerate(least):
                part = slice(n * batch, (n + 1) * batch)
                equal[alive] += (x[alive, part] == y[alive, part]).sum(axis=1)
                alive = alive[equal[alive] >= m]
            yield b.select(["a", "b"]).take(pa.array(alive))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in by_size(whole, "set_a", STEP_BYTES)):
            sims = similarities(b.column("set_a").to_pylist(), b.column("set_b").to_pylist())
            out = pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(sims)], ["a", "b", "sim"])
            yield out.filter(pa.array(sims >= threshold))

    def with_both(pairs: DataFrame, classes: DataFrame, column: str) -> DataFrame:
        x = classes.select(F.col("fp").alias("a"), F.col(column).alias(f"{column}_a"))
        y = classes.select(F.col("fp").alias("b"), F.col(column).alias(f"{column}_b"))
        return pairs.join(x, "a").join(y, "b").select("a", "b", f"{column}_a", f"{column}_b")

    likely = with_both(candidates, sigs, "sig").mapInArrow(prune, "a binary, b binary")
    return with_both(likely, sets, "set").mapInArrow(exact, "a binary, b binary, sim double")


def _candidates(entries: DataFrame, bucket_rows: int) -> DataFrame:
    """a < b of all classes that share a bucket; entries: bucket and fp, each once.

    Most buckets hold one class and end here. A bucket of more than ``bucket_rows`` classes is cut into parts, and
    every two parts meet in a task of their own."""
    hot = entries.groupBy("bucket").count().where(F.col("count") > bucket_rows).select("bucket", F.ceil(F.col("count") / bucket_rows).alias("parts"))
    hot = materialize(hot, "hot-buckets")
    members = F.count("*").over(Window.partitionBy("bucket"))  # of at most bucket_rows
    cold = materialize(entries.join(hot, "bucket", "left_anti").withColumn("n", members).where("n > 1").select("bucket", "fp"), "shared-buckets")
    pairs = cold.withColumnRenamed("fp", "a").join(cold.withColumnRenamed("fp", "b"), "bucket").where("a < b").select("a", "b")
    part = entries.join(hot, "bucket").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("long"))
    met = part.select("bucket", "fp", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("other"))
    met = met.select("bucket", "fp", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi")).repartition("bucket", "lo", "hi")
    x, y = (met.select("bucket", "lo", "hi", F.col("fp").alias(n), F.col("part").alias(f"part_{n}")) for n in "ab")
    hot = x.join(y, ["bucket", "lo", "hi"]).where((F.col("a") < F.col("b")) & ((F.col("part_a") != F.col("part_b")) | (F.col("lo") == F.col("hi")))).select("a", "b")
    return pairs.unionByName(hot)


def class_links(df: DataFrame, id_col: str, text_col: str, shingle: int = 5, threshold: float = 0.8, least_words: int = 0, bands: int = 32, rows: int = 3, size: int = 64, batch: int = 16, miss: float = 1e-4, bucket_rows: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Links a < b between classes with their similarity, and the classes' members (id, fp)."""
    found = materialize(_features(df, id_col, text_col, shingle, least_words, bands, rows, size), "shingles")
    members = found.select("id", "fp").distinct()
    classes = materialize(found.groupBy("fp").agg(F.first("bands").alias("bands"), F.first("sig").alias("sig")), "classes")
    sets = found.groupBy("fp").agg(F.first("set").alias("set"))
    candidates = _candidates(classes.select("fp", F.explode(F.array_distinct("bands")).alias("bucket")), bucket_rows).distinct()
    return _verified(candidates, classes.select("fp", "sig"), sets, threshold, batch, size, miss), members


def near_duplicate_pairs(df: DataFrame, id_col: str, text_col: str, part_rows: int = PART_ROWS, **how) -> DataFrame:
    """id_a < id_b of all pairs of records whose similarity reaches the threshold."""
    links, members = class_links(df, id_col, text_col, **how)
    links, members = materialize(links.select("a", "b"), "links"), materialize(members, "members")
    large = members.groupBy("fp").count().where(F.col("count") > part_rows).select("fp", F.ceil(F.col("count") / part_rows).alias("parts"))
    large = materialize(large, "large-classes")
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    in_parts = members.join(large, "fp", "left").select("fp", "id", F.pmod(F.xxhash64("id"), parts).alias("part"))

    def each_part(rows: DataFrame, fp: str) -> DataFrame:
        """``rows`` once for each part of the class ``fp``."""
        return rows.join(large.withColumnRenamed("fp", fp), fp, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts")

    x = each_part(links, "a").join(in_parts.select(F.col("fp").alias("a"), "part", F.col("id").alias("x")), ["a", "part"]).drop("part")
    across = each_part(x, "b").join(in_parts.select(F.col("fp").alias("b"), "part", F.col("id").alias("y")), ["b", "part"])
    within = each_part(members, "fp").select("fp", "part", F.col("id").alias("id_a")).join(in_parts.select("fp", "part", F.col("id").alias("id_b")), ["fp", "part"]).where("id_a < id_b")
    return across.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).unionByName(within.select("id_a", "id_b"))


def components(links: DataFrame) -> DataFrame:
    """node, root (smallest node of its component), by alternating large-star and small-star steps until nothing changes; their number grows with the logarithm of the links."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars")
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = materialize(small, "stars")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")


def near_duplicate_groups(df: DataFrame, id_col: str, text_col: str, **how) -> DataFrame:
    """One row per record: id, class_id (smallest id of those with an equal shingle set), group_id (smallest id of the linked classes) and links (other classes it is linked to)."""
    links, members = class_links(df, id_col, text_col, **how)
    links, members = materialize(links.select("a", "b"), "links"), materialize(members, "members")
    degree = links.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("links"))
    classes = members.groupBy("fp").agg(F.min("id").alias("class_id")).join(components(links).withColumnRenamed("node", "fp"), "fp", "left").join(degree, "fp", "left")
    classes = materialize(classes.select("fp", "class_id", F.coalesce("root", "fp").alias("root"), F.coalesce("links", F.lit(0).cast("long")).alias("links")), "grouped-classes")
    groups = classes.groupBy("root").agg(F.min("class_id").alias("group_id"))
    return members.join(classes.join(groups, "root"), "fp").select("id", "class_id", "group_id", "links")


#: The problem's own measure.
P2 = {"shingle": 3, "threshold": 0.6, "least_words": 20}


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of records whose contents are nearly the same."""
    return near_duplicate_pairs(table(spark, sf_dir, "embedding_records"), "id", "content", **P2)


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every record, across all sites."""
    return near_duplicate_groups(table(spark, sf_dir, "embedding_records"), "id", "content", **P2)


#: All pairs by brute force over an inverted index of shingles. Candidates may miss a pair near 0.6: none of 8,876 on sf0.1.
_CLASSES_SQL = """
with recursive r as (select distinct id, content from embedding_records where id is not null and content is not null),
w as (select id, regexp_extract_all(lower(content), '[a-z0-9]+') as w from r),
s as materialized (select distinct id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select id, w, unnest(range(1, len(w) - 1)) as i from w where len(w) >= 20)),
k as materialized (select id, md5(string_agg(g, '|' order by g)) as k, count(*) as n from s group by id),
t as materialized (select k, min(id) as id, any_value(n) as n from k group by k),
u as materialized (select k, n, g from t join s using (id)),
p as materialized (select a.k as ka, b.k as kb, count(*) as both from u a join u b on a.g = b.g and a.k < b.k group by a.k, b.k, a.n, b.n having count(*) >= 0.6 * (a.n + b.n - count(*))),
"""
P2_FOUND_SQL = _CLASSES_SQL + """
l as (select ka, kb from p union all select k, k from t)
select least(x.id, y.id) as id_a, greatest(x.id, y.id) as id_b from l join k x on x.k = l.ka join k y on y.k = l.kb where x.id <> y.id and (l.ka <> l.kb or x.id < y.id)
"""
P2_GROUPS_SQL = _CLASSES_SQL + """
e as (select ka as a, kb as b from p union all select kb, ka from p),
c as (select k as a, k as b from t union select c.a, e.b from c join e on e.a = c.b),
g as (select c.a as k, min(t.id) as group_id from c join t on t.k = c.b group by c.a),
d as (select a as k, count(*) as links from e group by a)
select k.id, t.id as class_id, group_id, coalesce(links, 0) as links from k join t using (k) join g using (k) left join d using (k)
"""

QUERIES = {"p2_found": p2_found, "p2_groups": p2_groups}
ORACLES = {"p2_found": P2_FOUND_SQL, "p2_groups": P2_GROUPS_SQL}

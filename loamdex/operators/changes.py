"""Changes as snapshots: each function takes tables and returns what they are afterwards.

Parquet has no update in place. A change is a join of the old rows with the new ones; ``swap`` writes a snapshot
beside the old one and then renames, so that no job reads what it overwrites.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def insert_sites(sites: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """``sites`` and the new ones (index_url, base_url, name, version) as pending. Taken addresses, and names with version, are refused; ids go on from the largest."""
    fresh = new.dropDuplicates(["index_url"]).dropDuplicates(["name", "version"])
    fresh = fresh.join(sites.select("index_url"), "index_url", "left_anti").join(sites.select("name", "version"), ["name", "version"], "left_anti")
    top = sites.agg(F.max("id")).first()[0] or 0
    # Sites are added by hand, a few at a time: their numbers come from one sorted list.
    numbered = fresh.agg(F.sort_array(F.collect_list(F.struct("index_url", "base_url", "name", "version"))).alias("a")).select(F.posexplode("a").alias("_n", "s"))
    given = {"id": (F.lit(top) + F.col("_n") + 1).cast("long"), "status": F.lit("pending"), "progress_percent": F.lit(0).cast("long"), "total_pages": F.lit(0).cast("long"), "indexed_pages": F.lit(0).cast("long"), "created_date": now}
    rows = numbered.select(*(given[f.name].alias(f.name) if f.name in given else F.col(f"s.{f.name}").alias(f.name) if f.name in ("index_url", "base_url", "name", "version") else F.lit(None).cast(f.dataType).alias(f.name) for f in sites.schema.fields))
    return sites.unionByName(rows)


def enqueue(queue: DataFrame, urls: DataFrame, now: Column) -> DataFrame:
    """The queue with the addresses (site_id, url): known ones become pending again and keep all else, new ones are added. Ids of new items are hashes of site and address, so a repeated run adds nothing."""
    old = queue.alias("o")
    new = urls.select("site_id", "url").where("site_id is not null and url is not null").distinct().withColumn("_new", F.lit(True)).alias("n")
    j = old.join(new, (F.col("o.site_id") == F.col("n.site_id")) & (F.col("o.url") == F.col("n.url")), "full_outer")
    added = F.col("o.id").isNull() & F.col("_new").isNotNull()
    value = {
        "id": F.coalesce("o.id", F.xxhash64("n.site_id", "n.url").bitwiseAND(F.lit(2**62 - 1)) + F.lit(2**62)),
        "site_id": F.coalesce("o.site_id", "n.site_id"),
        "url": F.coalesce("o.url", "n.url"),
        "status": F.when(F.col("_new").isNotNull(), "pending").otherwise(F.col("o.status")),
        "retry_count": F.coalesce("o.retry_count", F.lit(0).cast("long")),
        "created_date": F.when(added, now).otherwise(F.col("o.created_date")),
    }
    return j.select(*(value.get(c, F.col(f"o.{c}")).alias(c) for c in queue.columns))


def sparse_update(rows: DataFrame, changes: DataFrame, key: str = "id", clear: Sequence[str] = ()) -> DataFrame:
    """Columns of ``changes`` replace those of the row with their key where they aren't null; columns in ``clear`` become null for changed rows."""
    columns = [c for c in changes.columns if c != key]
    new = changes.select(key, F.lit(True).alias("_hit"), *(F.col(c).alias(f"_new_{c}") for c in columns))
    j = rows.join(new, key, "left")
    pick = lambda c: F.when(F.col("_hit"), F.lit(None)).otherwise(F.col(c)) if c in clear else F.coalesce(F.col(f"_new_{c}"), F.col(c)) if c in columns else F.col(c)
    return j.select(*(pick(c).alias(c) for c in rows.columns))


def set_status(queue: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The queue after outcomes (id, status, error_message): a failure adds a retry."""
    new = outcomes.select("id", F.col("status").alias("_s"), F.col("error_message").alias("_e"))
    j = queue.join(new, "id", "left")
    pick = {"status": F.coalesce("_s", "status"), "error_message": F.coalesce("_e", "error_message"), "retry_count": F.col("retry_count") + F.when(F.col("_s") == "failed", 1).otherwise(0)}
    return j.select(*(pick.get(c, F.col(c)).alias(c) for c in queue.columns))


def requeue_stale(queue: DataFrame, before: Column) -> DataFrame:
    """Items left in processing since before a moment become pending; nothing else would take them up again."""
    stale = (F.col("status") == "processing") & (F.col("created_date") < before)
    return queue.withColumn("status", F.when(stale, "pending").otherwise(F.col("status")))


def delete_sites(ids: DataFrame, sites: DataFrame, children: Sequence[DataFrame]) -> tuple[DataFrame, list[DataFrame]]:
    """Sites without those of ``ids`` (column id), and each child table without their rows."""
    gone = ids.select("id").distinct()
    return sites.join(gone, "id", "left_anti"), [c.join(gone.withColumnRenamed("id", "site_id"), "site_id", "left_anti").select(*c.columns) for c in children]


def without_site(rows: DataFrame, site_id: int) -> DataFrame:
    """A queue, chunk or vector table without the rows of one site; those of no site stay."""
    return rows.where(F.coalesce(F.col("site_id") != site_id, F.lit(True)))


def swap(df: DataFrame, path: str, partition_by: Sequence[str] = (), form: str = "parquet") -> DataFrame:
    """Writes the snapshot beside ``path``, then puts it there; the table before stays readable until the rename."""
    spark = df.sparkSession
    staged, old = f"{path}.{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.format(form).partitionBy(*partition_by).save(staged)
    jvm = spark._jvm
    to = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = to(path).getFileSystem(spark._jsc.hadoopConfiguration())
    existed = fs.exists(to(path))
    if existed and not fs.rename(to(path), to(old)):
        raise OSError(f"{path} can't be moved away")
    if not fs.rename(to(staged), to(path)):
        raise OSError(f"{staged} can't be moved to {path}")
    if existed:
        fs.delete(to(old), True)
    return spark.read.format(form).schema(df.schema).load(path)


def compact(spark: SparkSession, path: str, target_mb: int = 128, partition_by: Sequence[str] = ()) -> DataFrame:
    """The table rewritten in files of about ``target_mb``."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return swap(spark.read.parquet(path).repartition(max(1, -(-size // (target_mb << 20)))), path, partition_by)


def compact_small(spark: SparkSession, path: str, most_files: int = 8, target_mb: int = 128) -> bool:
    """Compacts a table, or one partition of it, that has more than ``most_files`` files of less than half the target on average; whether it did."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return False
    held = fs.getContentSummary(at)
    if held.getFileCount() <= most_files or held.getLength() / held.getFileCount() >= (target_mb << 19):
        return False
    compact(spark, path, target_mb)
    return True


def integrity(tables: dict[str, DataFrame], problems: dict[str, Column], keys: dict[str, Sequence[str]]) -> DataFrame:
    """table, problem, rows: broken row rules, and keys that should be unique but aren't."""
    out = None
    for name, df in tables.items():
        parts = []
        if name in problems:
            parts.append(df.select(problems[name].alias("problem")).where("problem is not null").groupBy("problem").agg(F.count("*").alias("rows")))
        for k in keys.get(name, ()):
            parts.append(df.groupBy(k).agg(F.count("*").alias("n")).where("n > 1").agg(F.sum("n").alias("rows")).where("rows > 0").select(F.lit(f"repeated {k}").alias("problem"), "rows"))
        for p in parts:
            p = p.select(F.lit(name).alias("table"), "problem", "rows")
            out = p if out is None else out.unionByName(p)
    return out

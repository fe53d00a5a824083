"""References to records that do not exist.

``orphan_cascade`` takes relations and the foreign keys between them. A reference is a *direct* orphan if it is
neither null nor blank and no live record has its key. A record that holds a direct orphan is orphaned; children
of orphaned records are *inherited* orphans, found by semi-joins down the foreign-key graph until a round adds
none (so chains and cycles of any length end).

Defined cases: null and blank references are no orphans; a key of another spelling is the same key once both
sides are passed through the same normaliser; rows repeated with the same key count once; an empty parent table
makes every reference to it an orphan; an empty child table gives no rows; a month that can't be read is
``unknown``; other columns of the inputs, whatever their names, are not carried along.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamdex.plans.scratch import materialize

_OUTER = r"(?U)^[\s​﻿]+|[\s​﻿]+$"


@dataclass(frozen=True)
class ForeignKey:
    """``child.field`` holds keys of ``parent``."""

    child: str
    field: str
    parent: str


@dataclass(frozen=True)
class Relation:
    """rows: ``record_key`` (string), ``self_key`` (what children refer to, or null), ``ref_month`` and one column per foreign-key field.
    live: ``key`` of every record that counts as present; None for a relation that nothing refers to."""

    rows: DataFrame
    live: DataFrame | None = None


def trimmed(c: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(c, _OUTER, "")


def uuid_key(c: Column) -> Column:
    """32 lower-case hex digits for any usual spelling of a UUID, null for null or blank, else the trimmed text after ``?``."""
    t = trimmed(c)
    bare = F.regexp_replace(F.regexp_replace(F.lower(t), r"^urn:uuid:", ""), r"^\{(.*)\}$", "$1")
    bare = F.regexp_replace(bare, "-", "")
    return F.when(t == "", None).when(bare.rlike("^[0-9a-f]{32}$"), bare).otherwise(F.concat(F.lit("?"), t))


def integer_key(c: Column) -> Column:
    """The integer that a string spells, without leading zeros; null for null or blank, else the trimmed text after ``?``."""
    t = trimmed(c)
    sign = F.when(t.startswith("-"), "-").otherwise("")
    digits = F.regexp_replace(F.regexp_replace(t, "^[+-]", ""), "^0+(?=[0-9])", "")
    spelled = F.when(digits == "0", "0").otherwise(F.concat(sign, digits))
    return F.when(t == "", None).when(t.rlike("^[+-]?[0-9]+$"), spelled).otherwise(F.concat(F.lit("?"), t))


def month_of_text(c: Column) -> Column:
    """UTC month of an RFC 3339 text in any zone, ``unknown`` if it is none; a text without zone counts as UTC."""
    t = F.upper(trimmed(c))
    shaped = t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?( ?(Z|[+-][0-9]{2}(:?[0-9]{2})?))?)?$")
    zoned = F.when(t.rlike(r"(Z|[0-9:.]{4,}[+-][0-9]{2}(:?[0-9]{2})?)$"), t).otherwise(F.concat(t, F.when(t.contains(":"), "Z").otherwise("T00:00:00Z")))
    zoned = F.regexp_replace(F.regexp_replace(zoned, r" ?([+-][0-9]{2}):?([0-9]{2})$", "$1:$2"), r" ?([+-][0-9]{2})$", "$1:00")
    # The fixed point of the calendar is UTC: micros since the epoch don't depend on the session's zone.
    day = F.expr("date_from_unix_date(0)")
    moment = F.when(shaped, zoned).try_cast("timestamp")
    return F.coalesce(F.date_format(F.date_add(day, F.floor(F.unix_micros(moment) / F.lit(86_400_000_000)).cast("int")), "yyyy-MM"), F.lit("unknown"))


def month_of_time(c: Column) -> Column:
    """Month of a timestamp without zone, ``unknown`` for null."""
    return F.coalesce(F.date_format(c, "yyyy-MM"), F.lit("unknown"))


def live_chunks(chunks: DataFrame, deletions: DataFrame) -> DataFrame:
    """Keys of chunks that have a row and whose last deletion isn't later than their last writing."""
    written = chunks.select(uuid_key(F.col("vector_id")).alias("key"), F.col("indexed_date").alias("w"), F.lit(None).cast("timestamp_ntz").alias("d"))
    deleted = deletions.select(uuid_key(F.col("vector_id")).alias("key"), F.lit(None).cast("timestamp_ntz").alias("w"), F.col("deleted_at").alias("d"))
    both = written.withColumn("n", F.lit(1)).unionByName(deleted.withColumn("n", F.lit(0))).where("key is not null")
    last = both.groupBy("key").agg(F.max("w").alias("w"), F.max("d").alias("d"), F.max("n").alias("n"))
    return last.where((F.col("n") == 1) & ~F.coalesce((F.col("d") > F.col("w")) | (F.col("d").isNotNull() & F.col("w").isNull()), F.lit(False))).select("key")


def orphan_cascade(relations: Mapping[str, Relation], keys: Sequence[ForeignKey]) -> DataFrame:
    """Every orphan reference: src_table, src_field, record_key, ref_key, ref_month, kind (direct or inherited), depth (0 for direct).

    A reference is reported once per record, with the smallest depth. Each round joins only the records orphaned
    in the round before, so the work of all rounds is bounded by the number of orphans and of their children.
    """

    def found(fk: ForeignKey, against: DataFrame, how: str, kind: str, depth: int) -> DataFrame:
        rows = relations[fk.child].rows
        refs = rows.select("record_key", "self_key", F.col(fk.field).alias("ref_key"), "ref_month").where(F.col("ref_key").isNotNull())
        hit = refs.join(against.withColumnRenamed("key", "ref_key"), "ref_key", how)
        return hit.select(F.lit(fk.child).alias("src_table"), F.lit(fk.field).alias("src_field"), "record_key", "self_key", "ref_key", "ref_month", F.lit(kind).alias("kind"), F.lit(depth).alias("depth"))

    def once(df: DataFrame) -> DataFrame:
        return df.groupBy("src_table", "src_field", "record_key").agg(*(F.min(c).alias(c) for c in ("self_key", "ref_key", "ref_month", "kind", "depth")))

    parents = {fk.parent for fk in keys}
    direct = materialize(once(reduce(DataFrame.unionByName, [found(fk, relations[fk.parent].live, "left_anti", "direct", 0) for fk in keys])), "orphans")
    rounds, seen = [direct], None
    newly = {p: direct.where((F.col("src_table") == p) & F.col("self_key").isNotNull()).select(F.col("self_key").alias("key")).distinct() for p in parents}
    children = [fk for fk in keys if any(up.child == fk.parent for up in keys)]
    depth = 0
    while children:  # every round but the last adds records, so it ends
        depth += 1
        seen = reduce(DataFrame.unionByName, rounds)
        step = once(reduce(DataFrame.unionByName, [found(fk, newly[fk.parent], "left_semi", "inherited", depth) for fk in children]))
        step = materialize(step.join(seen.select("src_table", "src_field", "record_key"), ["src_table", "src_field", "record_key"], "left_anti"), "orphans")
        if step.isEmpty():
            break
        known = seen.select("src_table", F.col("self_key").alias("key")).distinct()
        rounds.append(step)
        newly = {p: step.where((F.col("src_table") == p) & F.col("self_key").isNotNull()).select(F.col("self_key").alias("key")).distinct().join(known.where(F.col("src_table") == p).select("key"), "key", "left_anti") for p in parents}
    return reduce(DataFrame.unionByName, rounds).drop("self_key")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, field and month, direct and inherited ones apart."""
    return orphans.groupBy("src_table", "src_field", "ref_month").agg(
        F.count_if(F.col("kind") == "direct").alias("direct_orphans"),
        F.count_if(F.col("kind") == "inherited").alias("inherited_orphans"),
        F.countDistinct("ref_key").alias("missing_keys"),
    )


def index_orphans(sites: DataFrame, queue: DataFrame, chunks: DataFrame, deletions: DataFrame, records: DataFrame) -> DataFrame:
    """The cascade over the engine's own tables: sites, crawl_queue, indexed_chunks and embedding_records."""
    number = lambda c: F.when(F.col(c).isNotNull(), integer_key(F.col(c).cast("string")))
    none = F.lit(None).cast("string")
    relations = {
        "sites": Relation(sites.select(F.col("id").cast("string").alias("record_key")), sites.where("id is not null").select(F.col("id").cast("string").alias("key")).distinct()),
        "crawl_queue": Relation(queue.where("id is not null").select(F.col("id").cast("string").alias("record_key"), none.alias("self_key"), number("site_id").alias("site_id"), month_of_time(F.col("created_date")).alias("ref_month"))),
        "indexed_chunks": Relation(
            chunks.where("id is not null").select(F.col("id").cast("string").alias("record_key"), uuid_key(F.col("vector_id")).alias("self_key"), number("site_id").alias("site_id"), month_of_time(F.col("indexed_date")).alias("ref_month")),
            live_chunks(chunks, deletions),
        ),
        "embedding_records": Relation(
            records.where("id is not null").select(F.col("id").alias("record_key"), none.alias("self_key"), uuid_key(F.col("chunk_id")).alias("chunk_id"), integer_key(F.col("site_id")).alias("site_id"), month_of_text(F.col("created_at")).alias("ref_month"))
        ),
    }
    keys = [
        ForeignKey("embedding_records", "chunk_id", "indexed_chunks"),
        ForeignKey("embedding_records", "site_id", "sites"),
        ForeignKey("crawl_queue", "site_id", "sites"),
        ForeignKey("indexed_chunks", "site_id", "sites"),
    ]
    return orphan_cascade(relations, keys)

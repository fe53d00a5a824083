"""Lines repeated across the documents of one source, by a distributed suffix array over line identifiers.

Every section is a sequence of line identifiers (hashes of normalised lines; short lines are left out). Its
suffixes are sorted per source by one range partitioning of all executors: that order is the suffix array. Common
prefixes of neighbours in it give the repeated blocks; for each suffix the longest block that starts there and is
on at least ``least_pages`` documents of the source is kept. Suffixes are sorted by their first ``DEPTHS[0]`` lines; those
that share a block of so many are sorted again by the lines after it, until no block goes on: blocks have any length.
A block that reaches over the edge of a partition is decided by joining what both sides know of it (never more than
``least_pages`` documents each), so the result does not depend on the partitioning, and a line that is on a third of
all pages is spread over as many tasks as its rows need; tasks are as many as the rows ask for.

A line is removed if it belongs to such a block.

Defined cases: null or empty sections and contents give nothing; a page without a known source has no case; rows
repeated with the same page id count as one document; equal lines within a document count once for the
threshold and are each an occurrence; empty tables give no rows; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamdex.plans.scratch import counted, materialize
from loamdex.sources.tables import table

#: Lines by which suffixes are sorted in the first pass, in the second, and in each after that.
DEPTHS = (6, 32, 128)
#: Line identifiers (suffixes times depth) that one task sorts and holds at most, and below which more tasks aren't worth it.
TASK_KEYS, LEAST_KEYS = 2_000_000, 200_000


def plain_line(line: Column) -> Column:
    """White space runs as one blank and none outside, runs of digits as one 0."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(line, r"(?U)\s+", " "), "^ | $", ""), "[0-9]+", "0")


def website(base_url: Column) -> Column:
    """Without scheme, letter case and a slash at the end."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(base_url)), "^[a-z][a-z0-9+.-]*://", ""), "/$", "")


def line_keys(pages: DataFrame, least_chars: int) -> DataFrame:
    """source, page_id, section_no, line numbers and keys (line identifiers) of the lines of each section that are long enough, and a hash of them all (version); pages: source, page_id, sections."""
    section = pages.select("source", "page_id", F.posexplode("sections").alias("section_no", "s")).select("source", "page_id", "section_no", F.split("s.content", "\n", -1).alias("lines"))
    long_enough = F.filter(F.transform("lines", lambda line, i: F.struct(i.alias("no"), plain_line(line).alias("line"))), lambda x: F.length(x["line"]) >= least_chars)
    keyed = section.select("source", "page_id", "section_no", F.transform(long_enough, lambda x: F.struct(x["no"].alias("no"), F.xxhash64(F.lower(F.upper(x["line"]))).alias("key"))).alias("x"))
    return keyed.where(F.size("x") > 0).select("source", "page_id", "section_no", F.col("x.no").alias("numbers"), F.col("x.key").alias("keys"), F.xxhash64("x").alias("version"))


_PLACE = ["page_id", "section_no", "version", "at", "line_no"]


def _scan(least_pages: int, depth: int):
    """Over one sorted partition: found lines (kind 0), and occurrences (kind 1) or samples (kind 2) of blocks that touch its edges."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = [b for b in batches if b.num_rows]
        if not part:
            return
        t = pa.Table.from_batches(part)
        source, page = (t.column(n).to_numpy() for n in ("source", "page_id"))
        keys = np.stack([t.column(f"k{d}").to_numpy() for d in range(depth)], 1)
        n = len(source)
        same = source[1:] == source[:-1]
        best, block = np.zeros(n, np.int32), np.zeros(n, np.int64)
        hashed = source.astype(np.uint64)
        kinds, at, lengths, blocks = [], [], [], []
        rows = np.arange(n)
        for d in range(depth):
            same = same & (keys[1:, d] == keys[:-1, d]) & (keys[1:, d] != 0)
            group = np.concatenate([[0], np.cumsum(~same)])
            with np.errstate(over="ignore"):
                hashed = (hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + keys[:, d].astype(np.uint64)
            edge = ((group == group[0]) | (group == group[-1])) & (keys[:, d] != 0)
            large = np.bincount(group)[group] >= least_pages
            look = np.flatnonzero(large | edge)
            if not len(look):
                break
            order = look[np.lexsort((page[look], group[look]))]
            new = np.ones(len(order), bool)
            new[1:] = (group[order][1:] != group[order][:-1]) | (page[order][1:] != page[order][:-1])
            pages = np.bincount(group[order][new], minlength=group[-1] + 1)
            enough = (pages[group] >= least_pages) & (keys[:, d] != 0)
            best[enough] = d + 1
            block[enough] = hashed[enough].astype(np.int64)
            # What the other side of an edge needs: all pages of a block that isn't decided here, enough pages of one that is.
            undecided = rows[edge & ~enough]
            firsts = order[new]
            within = np.arange(len(firsts)) - np.searchsorted(group[firsts], group[firsts])
            sample = firsts[(within < least_pages) & (edge & enough)[firsts]]
            for kind, some in ((1, undecided), (2, sample)):
                kinds.append(np.full(len(some), kind, np.int32))
                at.append(some)
                lengths.append(np.full(len(some), d + 1, np.int32))
                blocks.append(hashed[some].astype(np.int64))
        found = np.flatnonzero(best)
        kinds.append(np.zeros(len(found), np.int32))
        at.append(found)
        lengths.append(best[found])
        blocks.append(block[found])
        rows = t.select(_PLACE).take(pa.array(np.concatenate(at)))
        for name, column in (("kind", kinds), ("lines", lengths), ("block", blocks)):
            rows = rows.append_column(name, pa.array(np.concatenate(column)))
        yield from rows.to_batches(max_chunksize=1 << 17)

    return scan


def tasks_for(keys: int, cores: int) -> int:
    """Tasks for so many keys: as many as there are cores, but fewer for little work, and more where a task would hold too much."""
    return max(1, min(-(-keys // LEAST_KEYS), max(cores, -(-keys // TASK_KEYS))))


def _blocks(suffixes: DataFrame, n: int, least_pages: int, depth: int) -> DataFrame:
    """Of each of the ``n`` suffixes (source, place, k0 ..) that begins with a repeated block its place, and lines (up to ``depth``) and hash of the longest."""
    order = ["source", *(f"k{d}" for d in range(depth)), "page_id"]
    tasks = tasks_for(n * depth, suffixes.sparkSession.sparkContext.defaultParallelism)
    array = suffixes.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    seen = materialize(array.mapInArrow(_scan(least_pages, depth), "page_id long, section_no int, version long, at int, line_no int, kind int, lines int, block long"), "suffix-blocks")
    # What both sides of an edge know of a block is a few rows for each partition it reaches into.
    pages_of = F.size(F.collect_set("page_id").over(Window.partitionBy("block", "lines")))
    edges = seen.where("kind > 0").withColumn("pages", pages_of)
    late = edges.where((F.col("kind") == 1) & (F.col("pages") >= least_pages))
    both = seen.where("kind = 0").select(*_PLACE, "lines", "block").unionByName(late.select(*_PLACE, "lines", "block"))
    return both.groupBy(*_PLACE).agg(F.max(F.struct("lines", "block")).alias("b")).select(*_PLACE, "b.lines", "b.block")


def repeated_lines(pages: DataFrame, least_pages: int = 5, least_chars: int = 15, depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    """page_id, section_no, line_no, at (its place among the lines that are long enough) and lines (of the longest repeated block that starts there) of every line of a repeated block.

    ``pages`` has source (string), page_id (long) and sections (array of structs with content)."""
    rows = pages.where("source is not null and page_id is not null").select(F.xxhash64("source").alias("source"), "page_id", "sections")
    sections, n = counted(line_keys(rows, least_chars), "line-keys", F.sum(F.size("keys")))

    def ahead(of: DataFrame, done: int, depth: int) -> DataFrame:
        """``of`` (source, place, keys) with the ``depth`` keys after the first ``done``, 0 beyond the end."""
        return of.selectExpr("source", *_PLACE, *(f"coalesce(try_element_at(keys, at + {done + d + 1}), 0L) as k{d}" for d in range(depth)))

    each = sections.select("source", "page_id", "section_no", "version", "keys", F.posexplode("numbers").alias("at", "line_no"))
    depth, done = depths[0], 0
    found, n = counted(_blocks(ahead(each, 0, depth), n, least_pages, depth), "blocks", F.count_if(F.col("lines") == depth))
    parts = []
    while True:
        parts.append(found.where(F.col("lines") < done + depth))
        if not n:
            break
        longer = found.where(F.col("lines") == done + depth)
        # Suffixes that share a block of the whole depth are one source, sorted by the lines after it.
        done, depth = done + depth, depths[min(len(parts), len(depths) - 1)]
        with_keys = longer.withColumnRenamed("block", "source").join(sections.select("page_id", "section_no", "version", "keys").dropDuplicates(["page_id", "section_no", "version"]), ["page_id", "section_no", "version"])
        more = _blocks(ahead(with_keys, done, depth), n, least_pages, depth).withColumnRenamed("lines", "more").withColumnRenamed("block", "after")
        found = longer.join(more, _PLACE, "left").select(*_PLACE, (F.lit(done) + F.coalesce("more", F.lit(0))).alias("lines"), F.coalesce("after", "block").alias("block"))
        found, n = counted(found, "blocks", F.count_if(F.col("lines") == done + depth))
    found = reduce(DataFrame.unionByName, parts)
    return found.groupBy("page_id", "section_no", "line_no").agg(F.max(F.struct("lines", "at")).alias("b")).select("page_id", "section_no", "line_no", "b.at", "b.lines")


def repeated_blocks(found: DataFrame, least_lines: int = 2) -> DataFrame:
    """page_id, section_no, line_no and lines of every occurrence of a repeated block of several lines that isn't the end of a longer one."""
    before = Window.partitionBy("page_id", "section_no").orderBy("at")
    part = (F.lag("at").over(before) == F.col("at") - 1) & (F.lag("lines").over(before) > F.col("lines"))
    blocks = found.withColumn("part", F.coalesce(part, F.lit(False)))
    return blocks.where(~F.col("part") & (F.col("lines") >= least_lines)).select("page_id", "section_no", "line_no", "lines")


def without_lines(pages: DataFrame, found: DataFrame) -> DataFrame:
    """page_id, section_no, content of every section without the found lines; a page id once."""
    gone = found.groupBy("page_id").agg(F.collect_list(F.struct("section_no", "line_no")).alias("gone"))
    once = pages.where("page_id is not null").select("page_id", "sections").dropDuplicates(["page_id"])
    sections = once.join(gone, "page_id", "left").select("page_id", "gone", F.posexplode("sections").alias("section_no", "s"))
    of_section = F.transform(F.filter(F.coalesce("gone", F.array().cast("array<struct<section_no:int,line_no:int>>")), lambda g: g["section_no"] == F.col("section_no")), lambda g: g["line_no"])
    lines = F.transform(F.split("s.content", "\n", -1), lambda line, i: F.named_struct(F.lit("i"), i, F.lit("line"), line))
    # Bound as the one element of an array, a section's line numbers are computed once and not for each line.
    kept = F.element_at(F.transform(F.array(of_section), lambda drop: F.filter(lines, lambda x: ~F.array_contains(drop, x["i"]))), 1)
    return sections.select("page_id", "section_no", F.array_join(F.transform(kept, lambda x: x["line"]), "\n").alias("content"))


def site_pages(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """source, page_id and sections of the cached pages; a source is a website in any spelling."""
    sources = sites.where("id is not null").select(F.col("id").alias("site_id"), website(F.col("base_url")).alias("source")).dropDuplicates(["site_id"])
    return pages.select("page_id", "site_id", "sections").join(sources, "site_id").select("source", "page_id", "sections")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of a line that is on at least 5 pages of one website."""
    pages = site_pages(table(spark, sf_dir, "extracted_pages"), table(spark, sf_dir, "sites"))
    return repeated_lines(pages).select("page_id", F.col("section_no").cast("long").alias("section_no"), F.col("line_no").cast("long").alias("line_no"))


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every section without the lines that its website repeats."""
    pages = table(spark, sf_dir, "extracted_pages")
    return without_lines(pages, repeated_lines(site_pages(pages, table(spark, sf_dir, "sites"))))


def p3_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of several lines that are on at least 5 pages of one website in this order."""
    pages = site_pages(table(spark, sf_dir, "extracted_pages"), table(spark, sf_dir, "sites"))
    return repeated_blocks(repeated_lines(pages))


_LINES_SQL = r"""
with src as (select id, regexp_replace(regexp_replace(lower(trim(base_url)), '^[a-z][a-z0-9+.-]*://', ''), '/$', '') as source from sites),
pages as (select distinct on (page_id) page_id, site_id, sections from extracted_pages),
s as (select page_id, source, unnest(sections).content as content, cast(generate_subscripts(sections, 1) - 1 as bigint) as section_no from pages join src on src.id = pages.site_id),
l as (select page_id, source, section_no, unnest(string_split(content, chr(10))) as line, cast(generate_subscripts(string_split(content, chr(10)), 1) - 1 as bigint) as line_no from s),
k as (select page_id, source, section_no, line_no, regexp_replace(regexp_replace(regexp_replace(line, '[\s\x{85}\x{0b}\p{Z}]+', ' ', 'g'), '^ | $', '', 'g'), '[0-9]+', '0', 'g') as line from l)
"""
P3_FOUND_SQL = _LINES_SQL + """,
c as (select source, lower(line) as line from k where length(line) >= 15 group by all having count(distinct page_id) >= 5)
select page_id, section_no, line_no from k join c on c.source = k.source and c.line = lower(k.line)
"""

#: Every start and length of a section, the longest that is on 5 pages, and of these the ones that the line before doesn't continue.
P3_BLOCKS_SQL = _LINES_SQL + """,
g as (select page_id, source, section_no, list(lower(line) order by line_no) as lines, list(line_no order by line_no) as numbers from k where length(line) >= 15 group by all),
a as (select *, unnest(range(1, len(lines) + 1)) as pos from g),
b as (select source, page_id, section_no, numbers[pos] as line_no, pos, unnest(range(1, len(lines) - pos + 2)) as n, lines from a),
h as (select source, page_id, section_no, line_no, pos, n, hash(lines[pos:pos + n - 1]) as h from b),
r as (select source, n, h from h group by all having count(distinct page_id) >= 5),
m as (select page_id, section_no, line_no, pos, max(n) as lines from h semi join r using (source, n, h) group by all),
w as (select *, lag(pos) over s as pos_before, lag(lines) over s as lines_before from m window s as (partition by page_id, section_no order by pos))
select page_id, cast(section_no as integer) as section_no, cast(line_no as integer) as line_no, cast(lines as integer) as lines from w where lines >= 2 and not coalesce(pos_before = pos - 1 and lines_before > lines, false)
"""
#: Lines of a section without those of P3_FOUND_SQL, in their order.
P3_CLEAN_SQL = P3_FOUND_SQL.rsplit("select page_id", 1)[0] + """,
d as (select page_id, section_no, line_no from k join c on c.source = k.source and c.line = lower(k.line)),
t as (select page_id, unnest(sections).content as content, cast(generate_subscripts(sections, 1) - 1 as integer) as section_no from (select distinct on (page_id) page_id, sections from extracted_pages where page_id is not null)),
x as (select page_id, section_no, content, unnest(string_split(content, chr(10))) as line, cast(generate_subscripts(string_split(content, chr(10)), 1) - 1 as bigint) as line_no from t)
select t.page_id, t.section_no, case when t.content is not null then coalesce(y.content, '') end as content from t left join (select page_id, section_no, string_agg(line, chr(10) order by line_no) as content from x anti join d using (page_id, section_no, line_no) group by all) y using (page_id, section_no)
"""

QUERIES = {"p3_found": p3_found, "p3_clean": p3_clean, "p3_blocks": p3_blocks}
ORACLES = {"p3_found": P3_FOUND_SQL, "p3_clean": P3_CLEAN_SQL, "p3_blocks": P3_BLOCKS_SQL}

"""Reads of the catalogue: sites, crawl queue and indexed chunks.

Lookups are filters that reach the scan; per-site figures are one grouped pass per child table, joined to the
sites, never a query per site. Ties in any order go to the smaller id. The moment that "now" means is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamdex.functions.text import iso_date, percent, seconds_between



def current_queue(rows: DataFrame) -> DataFrame:
    """One row per id: the one furthest on, if an item was delivered more than once. Partial aggregation, no window."""
    stage = F.when(F.col("status").isin("completed", "failed"), 2).when(F.col("status") == "processing", 1).otherwise(0)
    others = [c for c in rows.columns if c != "id"]
    best = F.max(F.struct("retry_count", stage.alias("stage"), "status", *(c for c in others if c not in ("retry_count", "status"))))
    return rows.where("id is not null").groupBy("id").agg(best.alias("r")).select("id", *(F.col(f"r.{c}").alias(c) for c in others))


def current_chunks(rows: DataFrame) -> DataFrame:
    """One row per id; rows delivered again are alike."""
    return rows.where("id is not null").dropDuplicates(["id"])


def site_by_id(sites: DataFrame, site_id: int) -> DataFrame:
    return sites.where(F.col("id") == site_id)


def site_by_name_version(sites: DataFrame, name: str, version: str) -> DataFrame:
    return sites.where((F.col("name") == name) & (F.col("version") == version))


def site_by_index_url(sites: DataFrame, url: str) -> DataFrame:
    return sites.where(F.col("index_url") == url)


def sites_by_status(sites: DataFrame, status: str) -> DataFrame:
    """Oldest first."""
    return sites.where(F.col("status") == status).orderBy("created_date", "id")


def completed_sites(sites: DataFrame) -> DataFrame:
    """Indexed last first."""
    return sites.where(F.col("status") == "completed").orderBy(F.col("indexed_date").desc_nulls_last(), "id")


def latest_sites(sites: DataFrame) -> DataFrame:
    """Created last first."""
    return sites.orderBy(F.col("created_date").desc(), "id")


def display_sites(sites: DataFrame) -> DataFrame:
    """By name, then version."""
    return sites.orderBy("name", "version", "id")


def resolve_site(sites: DataFrame, identifier: str) -> DataFrame:
    """The site of an id, or the one created last whose name holds the text in any letter case; at most one row."""
    text = identifier.strip()
    if text.lstrip("-").isdigit():
        return site_by_id(sites, int(text))
    return sites.where(F.lower("name").contains(text.lower())).orderBy(F.col("created_date").desc(), "id").limit(1)


def matching_sites(sites: DataFrame, pattern: str, mode: str = "contains") -> DataFrame:
    """All sites whose name or index address holds the text (letter case counts), or matches it as a regular expression."""
    hit = (lambda c: F.col(c).contains(pattern)) if mode == "contains" else (lambda c: F.col(c).rlike(pattern))
    return sites.where(hit("name") | hit("index_url"))


def queue_item(queue: DataFrame, item_id: int) -> DataFrame:
    return queue.where(F.col("id") == item_id)


def eligible(max_retries: int) -> Column:
    """Pending, or failed with retries left."""
    return (F.col("status") == "pending") | ((F.col("status") == "failed") & (F.col("retry_count") < max_retries))


def next_item(queue: DataFrame, site_id: int, max_retries: int = 3) -> DataFrame:
    """The oldest eligible item of one site."""
    return queue.where((F.col("site_id") == site_id) & eligible(max_retries)).orderBy("created_date", "id").limit(1)


def next_items(queue: DataFrame, max_retries: int = 3) -> DataFrame:
    """The oldest eligible item of every site: an aggregate with partial results, so that a site with a third of all items costs no more than others."""
    rest = [c for c in queue.columns if c not in ("created_date", "id", "site_id")]
    first = F.min(F.struct("created_date", "id", *rest)).alias("r")
    return queue.where(eligible(max_retries) & F.col("site_id").isNotNull()).groupBy("site_id").agg(first).select("site_id", "r.*").select(*queue.columns)


def completed_items(queue: DataFrame, site_id: int | None = None) -> DataFrame:
    """Oldest first."""
    rows = queue.where(F.col("status") == "completed")
    return (rows if site_id is None else rows.where(F.col("site_id") == site_id)).orderBy("created_date", "id")


def chunk_by_id(chunks: DataFrame, chunk_id: int) -> DataFrame:
    return chunks.where(F.col("id") == chunk_id)


def chunk_by_vector(chunks: DataFrame, vector_id: str) -> DataFrame:
    return chunks.where(F.col("vector_id") == vector_id)


def chunks_of_site(chunks: DataFrame, site_id: int) -> DataFrame:
    """In the order of pages and positions."""
    return chunks.where(F.col("site_id") == site_id).orderBy("url", "chunk_index", "id")


def status_flags(sites: DataFrame) -> DataFrame:
    """What a site's status says: done once completed or at 100 percent."""
    s = F.col("status")
    return sites.select("id", (s == "completed").alias("is_completed"), s.isin("pending", "indexing").alias("is_active"), (s == "failed").alias("is_failed"), ((s == "completed") | (F.col("progress_percent") == 100)).alias("is_done"))


def heartbeat_activity(sites: DataFrame, now: Column, within_seconds: int = 120) -> DataFrame:
    """Seconds since the last heartbeat and whether the indexer still seems at work."""
    age = seconds_between(F.col("last_heartbeat"), now)
    return sites.select("id", age.alias("seconds_since"), F.coalesce(age < within_seconds, F.lit(False)).alias("is_active"))


def site_statistics(sites: DataFrame, queue: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every site with its chunks, and its pending and failed queue items."""
    c = chunks.groupBy(F.col("site_id").alias("id")).agg(F.count("*").alias("total_chunks"))
    q = queue.groupBy(F.col("site_id").alias("id")).agg(F.count_if(F.col("status") == "pending").alias("pending_crawl_items"), F.count_if(F.col("status") == "failed").alias("failed_crawl_items"))
    return sites.join(c, "id", "left").join(q, "id", "left").fillna(0, ["total_chunks", "pending_crawl_items", "failed_crawl_items"])


def _queue_counts() -> list[Column]:
    return [F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in ("pending", "processing", "completed", "failed"))]


def queue_stats(queue: DataFrame, site_id: int) -> DataFrame:
    """Counts by status of one site, zeros where it has no items."""
    return queue.where(F.col("site_id") == site_id).agg(*_queue_counts())


def queue_stats_by_site(queue: DataFrame) -> DataFrame:
    return queue.where("site_id is not null").groupBy("site_id").agg(*_queue_counts())


def crawl_progress(queue: DataFrame) -> DataFrame:
    """Pages and whole percent done per site."""
    by = queue_stats_by_site(queue)
    return by.select("site_id", F.col("total").alias("total_pages"), F.col("completed").alias("indexed_pages"), percent(F.col("completed"), F.col("total")).alias("progress_percent"))


def status_summary(sites: DataFrame) -> DataFrame:
    """Sites per status."""
    return sites.groupBy("status").agg(F.count("*").alias("sites"))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("site_id").agg(F.count("*").alias("chunks"))


def crawl_counters(outcomes: DataFrame) -> DataFrame:
    """Attempts by outcome (successful, failed, robots_blocked) per site; each attempt counts."""
    o = F.col("outcome")
    return outcomes.groupBy("site_id").agg(F.count("*").alias("total_crawled"), *(F.count_if(o == x).alias(x) for x in ("successful", "failed", "robots_blocked")))


def crawl_outcome(counters: DataFrame) -> DataFrame:
    """What a site's crawl ends as: failed if nothing succeeded, else indexing, with a message where some failed."""
    s, f = F.col("successful"), F.col("failed")
    n = f.cast("string")
    return counters.withColumn("status", F.when((s == 0) & (f > 0), "failed").otherwise("indexing")).withColumn(
        "message", F.when((s == 0) & (f > 0), F.concat(F.lit("All "), n, F.lit(" crawl attempts failed"))).when(f > 0, F.concat(n, F.lit(" of "), (s + f).cast("string"), F.lit(" crawl attempts failed")))
    )


def pages_to_index(queue: DataFrame, chunks: DataFrame) -> DataFrame:
    """Completed items whose page has no chunk yet."""
    done = queue.where((F.col("status") == "completed") & F.col("site_id").isNotNull())
    return done.join(chunks.select("site_id", "url").distinct(), ["site_id", "url"], "left_anti")


def indexing_complete(queue: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per site, pages left to index and whether none are and nothing is left to crawl."""
    left = pages_to_index(queue, chunks).groupBy("site_id").agg(F.count("*").alias("pages_left"))
    open_ = queue.where("site_id is not null").groupBy("site_id").agg(F.count_if(F.col("status").isin("pending", "processing")).alias("open_items"))
    return open_.join(left, "site_id", "left").fillna(0, ["pages_left"]).withColumn("is_complete", (F.col("pages_left") == 0) & (F.col("open_items") == 0))


def average_tokens(chunks: DataFrame, page: str, tokens: str = "token_count") -> DataFrame:
    """Whole average of tokens per chunk of each page."""
    return chunks.groupBy(page).agg((F.sum(tokens) / F.greatest(F.count("*"), F.lit(1))).cast("long").alias("average_tokens"))


def list_sites(sites: DataFrame) -> DataFrame:
    """What the tool list_sites shows: completed sites, created last first."""
    rows = latest_sites(sites).where(F.col("status") == "completed")
    return rows.select("id", "name", "version", F.col("index_url").alias("url"), "status", F.col("indexed_pages").alias("page_count"), iso_date(F.col("indexed_date")).alias("indexed_date"))


def duplicate_urls(queue: DataFrame) -> DataFrame:
    """Addresses that are in the queue of their site more than once, and how often."""
    return queue.groupBy("site_id", "url").agg(F.count("*").alias("times")).where("times > 1")


def latest_per_name(sites: DataFrame) -> DataFrame:
    """The version of each name that was created last."""
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.col("created_date").desc(), "id"))
    return sites.withColumn("_rank", rank).where("_rank = 1").drop("_rank")

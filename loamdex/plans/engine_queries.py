"""The engine's queries over its own tables, each with SQL that gives the same rows over the same whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.functions import robots as R
from loamdex.functions import text as X
from loamdex.functions import urls as U
from loamdex.operators import catalog as C
from loamdex.operators import changes as D
from loamdex.operators import reconcile as O
from loamdex.operators import search as S
from loamdex.operators.chunking import sentence_chunks
from loamdex.operators.extract import extract_pages, page_links, page_sections
from loamdex.operators.frontier import closure
from loamdex.plans.scratch import new_path
from loamdex.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = _VIEWS + sql
        return f

    return register


class _Tables:
    """The engine's tables of a directory, one row per key."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.read = lambda n: table(spark, sf_dir, n)

    sites = property(lambda self: self.read("sites"))
    queue = property(lambda self: C.current_queue(self.read("crawl_queue")))
    chunks = property(lambda self: C.current_chunks(self.read("indexed_chunks")))
    documents = property(lambda self: self.read("documents"))
    vectors = property(lambda self: self.read("embeddings").select(F.concat(F.lit("v"), "vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("site_id")))
    records = property(lambda self: self.read("embedding_records").where("id is not null").select("id", F.when(X.trimmed(F.col("site_id")).rlike("^[+-]?[0-9]+$"), X.trimmed(F.col("site_id"))).try_cast("bigint").alias("site_id")).groupBy("id").agg(F.max("site_id").alias("site_id")))


_VIEWS = """
with recursive q as (select * exclude (rn, stage) from (select *, row_number() over (partition by id order by retry_count desc, stage desc, status desc, site_id desc, url desc, error_message desc, created_date desc) as rn
  from (select *, case when status in ('completed', 'failed') then 2 when status = 'processing' then 1 else 0 end as stage from crawl_queue where id is not null)) where rn = 1),
c as (select distinct on (id) * from indexed_chunks where id is not null),
v as (select 'v' || vec_id as id, embedding as vector, cast(label as bigint) as site_id from embeddings),
r as (select id, max(try_cast(case when regexp_matches(regexp_replace(site_id, '^\\s+|\\s+$', '', 'g'), '^[+-]?[0-9]+$') then regexp_replace(site_id, '^\\s+|\\s+$', '', 'g') end as bigint)) as site_id from embedding_records where id is not null group by id)
"""
_DISTANCE = "list_sum(list_transform(generate_series(1, len({a})), lambda i: (cast({a}[i] as double) - cast({b}[i] as double)) * (cast({a}[i] as double) - cast({b}[i] as double))))"
_NOW = "2025-06-30 00:00:00"


def _now():
    return F.to_timestamp_ntz(F.lit(_NOW))


# --- search


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The stored vector v0 as a query."""
    return [float(x) for x in table(spark, sf_dir, "embeddings").where("vec_id = 0").first().embedding]


_TOP = f"select id, site_id, round(d, 6) as distance, round(1 - d, 6) as score from (select v.id, v.site_id, {_DISTANCE.format(a='v.vector', b='z.vector')} as d from v, v as z where z.id = 'v0' {{where}}) order by d, id limit 10"


@query(_TOP.format(where=""))
def search_topk(spark, sf_dir):
    """The 10 vectors nearest to one."""
    got = S.top_k(_Tables(spark, sf_dir).vectors, _query_vector(spark, sf_dir), 10)
    return got.select("id", "site_id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


@query(_TOP.format(where="and v.site_id in (1, 3)"))
def search_topk_site_filter(spark, sf_dir):
    """The 10 nearest of two sites; the filter comes before the distances."""
    got = S.top_k(_Tables(spark, sf_dir).vectors, _query_vector(spark, sf_dir), 10, F.col("site_id").isin(1, 3))
    return got.select("id", "site_id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


@query(f"""select query_id, id, round(d, 6) as distance, rank from (select z.id as query_id, v.id, {_DISTANCE.format(a='v.vector', b='z.vector')} as d,
 row_number() over (partition by z.id order by {_DISTANCE.format(a='v.vector', b='z.vector')}, v.id) as rank from v, v as z where cast(substr(z.id, 2) as bigint) % 100 = 0) where rank <= 10""")
def search_batch_topk(spark, sf_dir):
    """The 10 nearest of all vectors for each vector whose id is divisible by 100."""
    v = _Tables(spark, sf_dir).vectors
    queries = v.where(F.substring("id", 2, 20).cast("long") % 100 == 0).select(F.col("id").alias("query_id"), "vector")
    return S.batch_top_k(queries, v, 10).select("query_id", "id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(f"""select 'text ' || t.id as content, 'u/' || t.id as url, 'title ' || t.id as page_title, coalesce(t.heading, 'N/A') as heading_path, coalesce(s.name, 'Unknown Site') as site_name, coalesce(s.version, 'unknown') as site_version, round(1 - d, 6) as relevance_score
 from (select v.id, v.site_id * 11 as site_id, case when cast(substr(v.id, 2) as bigint) % 2 = 0 then 'h' end as heading, {_DISTANCE.format(a='v.vector', b='z.vector')} as d from v, v as z where z.id = 'v0' order by d, v.id limit 10) t left join sites s on s.id = t.site_id""")
def search_results_enriched(spark, sf_dir):
    """Search results with the data of their site; unknown sites and missing headings have defaults."""
    t = _Tables(spark, sf_dir)
    rows = t.vectors.select("id", "vector", (F.col("site_id") * 11).alias("site_id"), F.concat(F.lit("text "), "id").alias("content"), F.concat(F.lit("u/"), "id").alias("page_url"), F.concat(F.lit("title "), "id").alias("page_title"), F.when(F.substring("id", 2, 20).cast("long") % 2 == 0, "h").alias("heading_path"))
    got = S.enriched(S.top_k(rows, _query_vector(spark, sf_dir), 10), t.sites)
    return got.withColumn("relevance_score", F.round("relevance_score", 6))


def _approximate(spark, sf_dir):
    """The 10 nearest of the approximate index for each vector whose id is divisible by 100."""
    v = _Tables(spark, sf_dir).vectors
    index = S.ApproximateIndex.build(v, new_path(spark, "vector-index"))
    queries = v.where(F.substring("id", 2, 20).cast("long") % 100 == 0).select(F.col("id").alias("query_id"), "vector")
    return index.search(queries, 10)


@query()
def search_lsh(spark, sf_dir):
    """Approximate search by random projections, exact order of the candidates."""
    return _approximate(spark, sf_dir).select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


@query("select count(*) as queries, true as recall_reached from v where cast(substr(id, 2) as bigint) % 100 = 0")
def search_lsh_recall(spark, sf_dir):
    """Whether the approximate search finds at least 0.9 of what the exact one finds."""
    exact, found = search_batch_topk(spark, sf_dir), _approximate(spark, sf_dir).select("query_id", "id", F.lit(1).alias("hit"))
    both = exact.join(found, ["query_id", "id"], "left")
    return both.agg(F.countDistinct("query_id").alias("queries"), (F.count("hit") / F.count("*") >= 0.9).alias("recall_reached"))


@query("select site_id, count(*) as vectors from r group by all")
def vector_count_by_site(spark, sf_dir):
    """Vector records of each site."""
    return _Tables(spark, sf_dir).records.groupBy("site_id").agg(F.count("*").alias("vectors"))


@query("""select problem, count(*) as rows from (select case when vector is null then 'no vector' when len(vector) <> 96 then 'another width' when len(list_filter(vector, lambda x: x is null or isnan(x) or isinf(x))) > 0 then 'not finite' end as problem from embedding_records) where problem is not null group by all""")
def vector_dimension_check(spark, sf_dir):
    """Why records can't be stored in a table of 96 dimensions."""
    from loamdex.schemas import vector_problem

    return table(spark, sf_dir, "embedding_records").select(vector_problem(96).alias("problem")).where("problem is not null").groupBy("problem").agg(F.count("*").alias("rows"))


# --- catalogue


@query("""select id, name, version, index_url as url, status, indexed_pages as page_count, strftime(indexed_date, '%Y-%m-%dT%H:%M:%SZ') as indexed_date
 from sites where status = 'completed'""")
def list_sites_completed(spark, sf_dir):
    """Completed sites as the tool lists them."""
    return C.list_sites(_Tables(spark, sf_dir).sites)


@query("select id, name, version, created_date from sites where status = 'failed'")
def sites_by_status(spark, sf_dir):
    return C.sites_by_status(_Tables(spark, sf_dir).sites, "failed").select("id", "name", "version", "created_date")


@query("select id, name, created_date from sites order by created_date desc, id")
def sites_latest_first(spark, sf_dir):
    """Every site, created last first."""
    return C.latest_sites(_Tables(spark, sf_dir).sites).select("id", "name", "created_date")


@query("select id, name, version from sites order by name, version")
def sites_display_order(spark, sf_dir):
    return C.display_sites(_Tables(spark, sf_dir).sites).select("id", "name", "version")


@query("select id, index_url from sites where status = 'completed' order by indexed_date desc, id")
def sites_completed_order(spark, sf_dir):
    return C.completed_sites(_Tables(spark, sf_dir).sites).select("id", "index_url")


@query("""select id, name from sites where id = 3 union all select id, name
 from sites where index_url like '%kestreldock%latest/'
 union all (select id, name from sites where lower(name) like '%harrow%'
 order by created_date desc, id limit 1)""")
def site_lookups(spark, sf_dir):
    """A site by id, by index address and by part of its name."""
    s = _Tables(spark, sf_dir).sites
    return C.site_by_id(s, 3).unionByName(s.where(F.col("index_url").like("%kestreldock%latest/"))).unionByName(C.resolve_site(s, "HARROW")).select("id", "name")


@query("select id, name, version from sites where name like '%loom%' or index_url like '%loom%'")
def sites_matching(spark, sf_dir):
    return C.matching_sites(_Tables(spark, sf_dir).sites, "loom").select("id", "name", "version")


@query("select arg_max(id, (created_date, -id)) as id, name from sites group by name")
def sites_latest_version(spark, sf_dir):
    """The version of each name created last."""
    return C.latest_per_name(_Tables(spark, sf_dir).sites).select("id", "name")


@query("select status, count(*) as sites from sites group by all")
def site_status_summary(spark, sf_dir):
    return C.status_summary(_Tables(spark, sf_dir).sites)


@query("""select id, status = 'completed' as is_completed, status in ('pending', 'indexing') as is_active, status = 'failed' as is_failed,
 status = 'completed' or progress_percent = 100 as is_done
 from sites""")
def site_status_flags(spark, sf_dir):
    return C.status_flags(_Tables(spark, sf_dir).sites)


@query("""select id, coalesce(total_chunks, 0) as total_chunks, coalesce(p, 0) as pending_crawl_items, coalesce(f, 0) as failed_crawl_items from sites
 left join (select site_id as id, count(*) as total_chunks from c group by all) using (id) left join (select site_id as id, count(*) filter (status = 'pending') as p, count(*) filter (status = 'failed') as f from q group by all) using (id)""")
def site_statistics(spark, sf_dir):
    t = _Tables(spark, sf_dir)
    return C.site_statistics(t.sites, t.queue, t.chunks).select("id", "total_chunks", "pending_crawl_items", "failed_crawl_items")


@query("""select count(*) as total, count(*) filter (status = 'pending') as pending, count(*) filter (status = 'processing') as processing,
 count(*) filter (status = 'completed') as completed, count(*) filter (status = 'failed') as failed
 from q where site_id = 1""")
def queue_stats(spark, sf_dir):
    return C.queue_stats(_Tables(spark, sf_dir).queue, 1)


@query("""select site_id, count(*) as total, count(*) filter (status = 'pending') as pending, count(*) filter (status = 'processing') as processing,
 count(*) filter (status = 'completed') as completed, count(*) filter (status = 'failed') as failed
 from q where site_id is not null group by all""")
def queue_stats_by_site(spark, sf_dir):
    return C.queue_stats_by_site(_Tables(spark, sf_dir).queue)


@query("""select site_id, n as total_pages, k as indexed_pages, cast(trunc((cast(k as double) / n) * 100.0) as bigint) as progress_percent
 from (select site_id, count(*) as n, count(*) filter (status = 'completed') as k
 from q where site_id is not null group by all)""")
def crawl_progress(spark, sf_dir):
    return C.crawl_progress(_Tables(spark, sf_dir).queue)


@query("""select site_id, id, url from (select *, row_number() over (partition by site_id
 order by created_date, id) as n from q where site_id is not null and (status = 'pending' or (status = 'failed' and retry_count < 3)))
 where n = 1""")
def next_pending_per_site(spark, sf_dir):
    """The item that each site's crawl takes up next."""
    return C.next_items(_Tables(spark, sf_dir).queue).select("site_id", "id", "url")


@query("select id, url from q where site_id = 1 and (status = 'pending' or (status = 'failed' and retry_count < 3)) order by created_date, id limit 1")
def next_pending_of_site(spark, sf_dir):
    return C.next_item(_Tables(spark, sf_dir).queue, 1).select("id", "url")


@query("select id, site_id, url from q where status = 'completed'")
def completed_queue_items(spark, sf_dir):
    return C.completed_items(_Tables(spark, sf_dir).queue).select("id", "site_id", "url")


@query("select id, url, chunk_index, vector_id from c where site_id = 2")
def chunks_of_site(spark, sf_dir):
    return C.chunks_of_site(_Tables(spark, sf_dir).chunks, 2).select("id", "url", "chunk_index", "vector_id")


@query("select site_id, count(*) as chunks from c group by all")
def chunk_count_by_site(spark, sf_dir):
    return C.chunk_counts(_Tables(spark, sf_dir).chunks)


@query("""select id, site_id, url from q where status = 'completed' and site_id is not null and not exists (select 1
 from c where c.site_id = q.site_id and c.url = q.url)""")
def pages_needing_index(spark, sf_dir):
    """Crawled pages without chunks."""
    t = _Tables(spark, sf_dir)
    return C.pages_to_index(t.queue, t.chunks).select("id", "site_id", "url")


@query("""select o.site_id, o.open_items, coalesce(l.n, 0) as pages_left, coalesce(l.n, 0) = 0 and o.open_items = 0 as is_complete from (select site_id, count(*) filter (status in ('pending', 'processing')) as open_items from q where site_id is not null group by all) o
 left join (select site_id, count(*) as n from q where status = 'completed' and site_id is not null and not exists (select 1 from c where c.site_id = q.site_id and c.url = q.url) group by all) l on l.site_id = o.site_id""")
def indexing_completion(spark, sf_dir):
    t = _Tables(spark, sf_dir)
    return C.indexing_complete(t.queue, t.chunks)


@query("select site_id, url, count(*) as times from q group by all having count(*) > 1")
def duplicate_queue_urls(spark, sf_dir):
    return C.duplicate_urls(_Tables(spark, sf_dir).queue)


@query(f"""select id, cast(floor(epoch(timestamp '{_NOW}' - last_heartbeat)) as bigint) as seconds_since,
 coalesce(floor(epoch(timestamp '{_NOW}' - last_heartbeat)) < 120, false) as is_active
 from sites""")
def site_heartbeats(spark, sf_dir):
    return C.heartbeat_activity(_Tables(spark, sf_dir).sites, _now())


@query("""select user_id as id, cast(floor(epoch(m.now - t)) as bigint) as seconds_since, floor(epoch(m.now - t)) < 120 as is_active from (select user_id, max(ts) as t from events group by all), (select max(ts) as now from events) m""")
def heartbeat_activity(spark, sf_dir):
    """Activity of each user of the events at the moment of the last one."""
    e = table(spark, sf_dir, "events")
    last = e.groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("last_heartbeat"))
    return C.heartbeat_activity(last, F.lit(e.agg(F.max("ts").cast("string")).first()[0]).cast("timestamp_ntz"))


@query("""select site_id, count(*) as total_crawled, count(*) filter (o = 'successful') as successful, count(*) filter (o = 'failed') as failed,
 count(*) filter (o = 'robots_blocked') as robots_blocked
 from (select site_id, case status when 'completed' then 'successful' when 'failed' then 'failed' else 'robots_blocked' end as o
 from q where site_id is not null) group by all""")
def crawl_counters(spark, sf_dir):
    rows = _Tables(spark, sf_dir).queue.where("site_id is not null")
    return C.crawl_counters(rows.select("site_id", F.when(F.col("status") == "completed", "successful").when(F.col("status") == "failed", "failed").otherwise("robots_blocked").alias("outcome")))


@query("""select id, upper(status[1]) || lower(status[2:]) as label, strftime(created_date, '%Y-%m-%d %H:%M:%S') as created,
 strftime(created_date, '%Y-%m-%dT%H:%M:%SZ') as created_iso
 from q""")
def queue_display(spark, sf_dir):
    """Labels and dates as shown to people."""
    return _Tables(spark, sf_dir).queue.select("id", X.display(F.col("status")).alias("label"), X.plain_date(F.col("created_date")).alias("created"), X.iso_date(F.col("created_date")).alias("created_iso"))


@query("""select coalesce(error_message, '') as message,
 regexp_matches(lower(coalesce(error_message, '')), 'timeout|connection|network|http error 5|http error 429') as is_retryable, count(*) as items
 from q group by all""")
def retryable_errors(spark, sf_dir):
    m = F.coalesce("error_message", F.lit(""))
    return _Tables(spark, sf_dir).queue.groupBy(m.alias("message"), X.retryable(m).alias("is_retryable")).agg(F.count("*").alias("items"))


# --- reconciliation

_STATE = """, done as (select id from sites where status = 'completed'),
cc as (select vector_id, max(site_id) as site_id from c where site_id in (select id from done) and vector_id is not null group by all),
st as (select coalesce(cc.vector_id, r.id) as vector_id, coalesce(cast(cc.site_id as varchar), cast(r.site_id as varchar)) as site_id, case when r.id is null then 'missing' when cc.vector_id is null then 'orphaned' else 'present' end as state from cc full join r on r.id = cc.vector_id)
"""


def _state(spark, sf_dir):
    t = _Tables(spark, sf_dir)
    return O.compared(t.sites, t.chunks, t.records)


@query(_STATE + "select vector_id, site_id from st where state = 'missing'")
def missing_vectors(spark, sf_dir):
    """Chunks of completed sites without a vector."""
    return O.missing_vectors(_state(spark, sf_dir))


@query(_STATE + "select vector_id, site_id from st where state = 'orphaned'")
def orphaned_vectors(spark, sf_dir):
    """Vectors without a chunk."""
    return O.orphaned_vectors(_state(spark, sf_dir))


@query(_STATE + """select site_id, count(*) filter (state <> 'orphaned') as chunks, count(*) filter (state = 'present') as present,
 count(*) filter (state = 'missing') as missing, count(*) filter (state = 'orphaned') as orphaned
 from st group by all having count(*) filter (state <> 'present') > 0""")
def consistency_by_site(spark, sf_dir):
    return O.consistency_by_site(_state(spark, sf_dir))


@query(_STATE + """select count(*) filter (state <> 'orphaned') as chunks, count(*) filter (state <> 'missing') as vectors,
 count(*) filter (state = 'missing') as missing, count(*) filter (state = 'orphaned') as orphaned, count(*) filter (state <> 'present') as issues,
 count(*) filter (state <> 'present') = 0 as is_consistent
 from st""")
def consistency_totals(spark, sf_dir):
    return O.consistency_totals(_state(spark, sf_dir))


@query(_STATE + """select case when sum(case when state <> 'present' then 1 else 0 end) = 0 then 'consistent' else format('{} issues: {} chunks without vector, {} vectors without chunk ({} chunks, {} vectors)', count(*) filter (state <> 'present'), count(*) filter (state = 'missing'), count(*) filter (state = 'orphaned'), count(*) filter (state <> 'orphaned'), count(*) filter (state <> 'missing')) end as summary
 from st""")
def consistency_summary(spark, sf_dir):
    return O.summary(O.consistency_totals(_state(spark, sf_dir)))


@query(_STATE + "select r.id, r.site_id from r where id not in (select vector_id from st where state = 'orphaned')")
def orphans_removed(spark, sf_dir):
    """The vector table without its orphans."""
    return O.without_orphans(_Tables(spark, sf_dir).records, _state(spark, sf_dir)).select("id", "site_id")


# --- changes


@query(f"""select coalesce(q.id, -1) as id, coalesce(q.site_id, n.site_id) as site_id, coalesce(q.url, n.url) as url, case when n.url is not null then 'pending' else q.status end as status, coalesce(q.retry_count, 0) as retry_count, case when q.id is null then timestamp '{_NOW}' else q.created_date end as created_date
 from q full join (select distinct site_id, url from c where site_id is not null) n on n.site_id = q.site_id and n.url = q.url""")
def enqueue_upsert(spark, sf_dir):
    """The queue after all addresses of indexed chunks were queued again; ids of new items show as -1."""
    t = _Tables(spark, sf_dir)
    got = D.enqueue(t.queue, t.chunks.select("site_id", "url"), _now())
    return got.select(F.when(F.col("id") >= 2**62, -1).otherwise(F.col("id")).alias("id"), "site_id", "url", "status", "retry_count", "created_date")


@query("""select id, name, version, case when id % 3 = 0 then 'failed' else status end as status,
 case when id % 3 = 0 then null else error_message end as error_message,
 case when id % 3 = 0 and id % 2 = 0 then total_pages + 1 else total_pages end as total_pages
 from sites""")
def sparse_site_update(spark, sf_dir):
    """Sites after a sparse update: nulls keep what is there, except for a column that is cleared."""
    s = _Tables(spark, sf_dir).sites
    changes = s.where("id % 3 = 0").select("id", F.lit("failed").alias("status"), F.when(F.col("id") % 2 == 0, F.col("total_pages") + 1).alias("total_pages"))
    return D.sparse_update(s, changes, clear=["error_message"]).select("id", "name", "version", "status", "error_message", "total_pages")


@query("""select id, case when status = 'processing' then 'failed' else status end as status,
 retry_count + case when status = 'processing' then 1 else 0 end as retry_count,
 case when status = 'processing' then 'timeout' else error_message end as error_message
 from q""")
def retry_increment(spark, sf_dir):
    """The queue after all items in processing failed."""
    q = _Tables(spark, sf_dir).queue
    return D.set_status(q, q.where("status = 'processing'").select("id", F.lit("failed").alias("status"), F.lit("timeout").alias("error_message"))).select("id", "status", "retry_count", "error_message")


@query("""select 'sites' as t, count(*) as rows from sites where status <> 'failed'
 union all select 'queue', count(*) from q where site_id is null or site_id not in (select id
 from sites where status = 'failed') union all select 'chunks', count(*)
 from c where site_id is null or site_id not in (select id
 from sites where status = 'failed')""")
def delete_site_cascade(spark, sf_dir):
    """What is left once all failed sites are deleted, with their queue items and chunks."""
    t = _Tables(spark, sf_dir)
    sites, (queue, chunks) = D.delete_sites(t.sites.where("status = 'failed'").select("id"), t.sites, [t.queue, t.chunks])
    count = lambda name, df: df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("t"), "rows")
    return count("sites", sites).unionByName(count("queue", queue)).unionByName(count("chunks", chunks))


@query("""select 'crawl_queue' as table, 'missing value' as problem, count(*) as rows
 from crawl_queue where site_id is null having count(*) > 0
 union all select 'crawl_queue', 'repeated id', cast(sum(n) as bigint)
 from (select count(*) as n from crawl_queue group by id
 having count(*) > 1) having sum(n) > 0 union all select 'indexed_chunks', 'repeated id', cast(sum(n) as bigint)
 from (select count(*) as n from indexed_chunks group by id
 having count(*) > 1) having sum(n) > 0""")
def integrity_check(spark, sf_dir):
    """Broken row rules and repeated keys of the raw tables."""
    from loamdex import schemas

    read = _Tables(spark, sf_dir).read
    return D.integrity({n: read(n) for n in ("sites", "crawl_queue", "indexed_chunks")}, {"sites": schemas.site_problem(), "crawl_queue": schemas.queue_problem()}, {"sites": ["id"], "crawl_queue": ["id"], "indexed_chunks": ["id"]})


# --- text and chunks

_WS = r"[^\s\x0b\x{85}\p{Z}]+"


def _tokens(t: str) -> str:
    return rf"cast((40 * len(regexp_extract_all({t}, '{_WS}')) + 3 * len(regexp_extract_all({t}, '[!-/:-@\[-`{{-~]'))) // 30 as bigint)"



@query(f"""select doc_id, {_tokens('text')} as tokens, contains(text, '```') or regexp_matches(text, '(?m)^ {{4}}') as has_code
 from documents where text is not null""")
def token_estimates(spark, sf_dir):
    d = _Tables(spark, sf_dir).documents.where("text is not null")
    return d.select("doc_id", X.estimated_tokens(F.col("text")).alias("tokens"), X.has_code(F.col("text")).alias("has_code"))


@query(f"select source, cast(sum({_tokens('text')}) // greatest(count(*), 1) as bigint) as average_tokens from documents where text is not null group by all")
def avg_tokens_by_source(spark, sf_dir):
    d = _Tables(spark, sf_dir).documents.where("text is not null").select("source", X.estimated_tokens(F.col("text")).alias("token_count"))
    return C.average_tokens(d, "source")


@query(f"""select case when n <= 160 then 'small' when n <= 640 then 'one chunk' when n <= 1024 then 'above target' else 'above maximum' end as size,
 count(*) as documents
 from (select {_tokens('text')} as n from documents where text is not null)
 group by all""")
def token_histogram(spark, sf_dir):
    n = X.estimated_tokens(F.col("text"))
    size = F.when(n <= 160, "small").when(n <= 640, "one chunk").when(n <= 1024, "above target").otherwise("above maximum")
    return _Tables(spark, sf_dir).documents.where("text is not null").groupBy(size.alias("size")).agg(F.count("*").alias("documents"))


@query(f"""select doc_id, case when len(w) > 60 then array_to_string(w[-60:], ' ') else '' end as tail
 from (select doc_id, regexp_extract_all(text, '{_WS}') as w
 from documents where text is not null)""")
def overlap_tail(spark, sf_dir):
    """What the next chunk of each document would begin with."""
    return _Tables(spark, sf_dir).documents.where("text is not null").select("doc_id", X.overlap_tail(F.col("text"), 80).alias("tail"))


@query(r"""select doc_id, i as part, trim(p, chr(32) || chr(9) || chr(10) || chr(13)) as content
 from (select doc_id, unnest(string_split(text, chr(10) || chr(10))) as p, cast(generate_subscripts(string_split(text, chr(10) || chr(10)), 1) - 1 as integer) as i
 from documents where text is not null) where regexp_matches(p, '[^\s\x0b\x{85}\p{Z}]')""")
def paragraph_split(spark, sf_dir):
    """Paragraphs of every document, blank ones left out."""
    d = _Tables(spark, sf_dir).documents.where("text is not null")
    each = d.select("doc_id", F.posexplode(F.split("text", "\n\n", -1)).alias("part", "p"))
    return each.where(~X.is_blank(F.col("p"))).select("doc_id", "part", F.regexp_replace("p", "^[ \t\n\r]+|[ \t\n\r]+$", "").alias("content"))


@query(rf"""
, pieces as materialized (select doc_id, i, t, {_tokens('t')} as n from (
  select doc_id, i, case when i < max(i) over (partition by doc_id) then x || '. ' else x end as t from (
   select doc_id, row_number() over (partition by doc_id order by j) as i, x from (
    select doc_id, j, regexp_replace(p, '^[\s\x0b\x{{85}}\p{{Z}}]+|[\s\x0b\x{{85}}\p{{Z}}]+$', '', 'g') as x from (
     select doc_id, unnest(string_split_regex(text, '[.!?]')) as p, generate_subscripts(string_split_regex(text, '[.!?]'), 1) as j from documents where text is not null)) where x <> '')))
, f as (select doc_id, i, n as total, 1 as k from pieces where i = 1
  union all select f.doc_id, p.i, case when f.total + p.n > 200 then p.n else f.total + p.n end, f.k + case when f.total + p.n > 200 then 1 else 0 end from f join pieces p on p.doc_id = f.doc_id and p.i = f.i + 1)
select doc_id, cast(count(distinct k) as bigint) as chunks, count(*) as pieces from f group by doc_id""")
def sentence_chunks_of_documents(spark, sf_dir):
    """Documents packed sentence by sentence to 200 tokens, in the JVM."""
    got = sentence_chunks(_Tables(spark, sf_dir).documents.where("text is not null").repartition("doc_id"), "doc_id", "text", 200)
    return got.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("pieces").alias("pieces"))


@query(r"""select page_id, section_no, s.heading_path as heading_path, cast(s.heading_level as integer) as heading_level, s.has_code_blocks as has_code_blocks from (select page_id, unnest(sections) as s, cast(generate_subscripts(sections, 1) - 1 as integer) as section_no from (select distinct on (page_id) * from extracted_pages))""")
def page_sections_rows(spark, sf_dir):
    """One row per section of the cached pages."""
    got = page_sections(table(spark, sf_dir, "extracted_pages").dropDuplicates(["page_id"]), "page_id")
    return got.select("page_id", "section_no", "heading_path", F.col("heading_level").cast("int").alias("heading_level"), "has_code_blocks")


def _as_html(pages: DataFrame) -> DataFrame:
    """Cached pages as HTML: headings, paragraphs, links and code of their Markdown as elements."""
    text = F.col("raw_text")
    for pattern, by in (("&", "&amp;"), ("<", "&lt;"), (r"(?m)^(```\w*)$", "<!--$1-->"), (r"(?m)^# (.*)$", "<h1>$1</h1>"), (r"(?m)^## (.*)$", "<h2>$1</h2>"), (r"(?m)^### (.*)$", "<h3>$1</h3>"), (r"\[([^\]]*)\]\(([^)\s]+)\)", "<a href=\"$2\">$1</a>"), (r"\n\s*\n", "\n<p>")):
        text = F.regexp_replace(text, pattern, by)
    page = F.concat(F.lit("<html><head><title>"), F.coalesce("title", F.lit("")), F.lit("</title></head><body><nav>menu</nav><main><p>"), text, F.lit("</main></body></html>"))
    return pages.where("raw_text is not null").dropDuplicates(["page_id"]).repartition("page_id").select("page_id", "site_id", "url", page.alias("html"))


@query(r"""select distinct page_id, regexp_replace(origin || case when h like '/%' then h else d || h end, '/index\.[a-zA-Z0-9]+$', '/') as link from (
 select page_id, lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1)) as origin, regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '[^/]*$', '') as d, b, unnest(regexp_extract_all(raw_text, '\[[^\]]*\]\(([^)\s]+)\)', 1)) as h
 from (select distinct on (page_id) * from extracted_pages where raw_text is not null) join (select id, regexp_replace(regexp_extract(base_url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '^$', '/') as p, case when p like '%/' then p else p || '/' end as b from sites) s on s.id = site_id)
 where not starts_with(h, '#') and starts_with(case when h like '/%' then h else d || h end, b)""")
def page_links_in_scope(spark, sf_dir):
    """Links of every page that lie below its site's base."""
    pages = _as_html(table(spark, sf_dir, "extracted_pages"))
    got = extract_pages(pages).join(_Tables(spark, sf_dir).sites.select(F.col("id").alias("site_id"), U.part(F.col("base_url"), "PATH").alias("base_path")), "site_id")
    base = F.concat(U.part(F.col("url"), "PROTOCOL"), F.lit("://"), U.part(F.col("url"), "HOST"), F.col("base_path"))
    return page_links(got, base, "page_id")


# --- URLs

_HOST = "regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)"
_PATH = "regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1)"


@query(f"select id, {_HOST} as host, {_PATH} as path from q")
def page_host_path(spark, sf_dir):
    return _Tables(spark, sf_dir).queue.select("id", U.part(F.col("url"), "HOST").alias("host"), U.part(F.col("url"), "PATH").alias("path"))


@query(rf"""select id, case when p like '%/' then p when regexp_matches(p, '/[^/]*\.[^/]*$') then regexp_replace(p, '[^/]*$', '') else p || '/' end as directory,
 regexp_replace(p, '/index\.[a-zA-Z0-9]+$', '/') as without_index
 from (select id, {_PATH} as p from q)""")
def normalized_base_path(spark, sf_dir):
    p = U.part(F.col("url"), "PATH")
    return _Tables(spark, sf_dir).queue.select("id", U.directory(p).alias("directory"), U.without_index(p).alias("without_index"))


@query(r"""select id, regexp_extract(index_url, '^([a-zA-Z]+://[^/?#]+)', 1) || '/robots.txt' as robots,
 case when p = '' then h else h || ' ' || replace(p, '/', ' ') end as default_name
 from (select id, index_url, regexp_extract(index_url, '^[a-zA-Z]+://([^/?#:]+)', 1) as h, regexp_extract(index_url, '^[a-zA-Z]+://[^/?#]+/([^?#]*)', 1) as p
 from sites)""")
def site_addresses(spark, sf_dir):
    """Where each site's robots rules are, and what it would be called."""
    return _Tables(spark, sf_dir).sites.select("id", U.robots_url(F.col("index_url")).alias("robots"), U.default_site_name(F.col("index_url")).alias("default_name"))


@query(r"""select q.id, lower(regexp_extract(q.url, '^([a-zA-Z]+)://', 1)) = lower(regexp_extract(s.base_url, '^([a-zA-Z]+)://', 1)) and lower(regexp_extract(q.url, '^[a-zA-Z]+://([^/?#:]+)', 1)) = lower(regexp_extract(s.base_url, '^[a-zA-Z]+://([^/?#:]+)', 1))
 and starts_with(case when regexp_extract(q.url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) = '' then '/' else regexp_extract(q.url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) end, case when b like '%/' then b when regexp_matches(b, '/[^/]*\.[^/]*$') then regexp_replace(b, '[^/]*$', '') else b || '/' end) as in_scope
 from q join (select *, case when regexp_extract(base_url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) = '' then '/' else regexp_extract(base_url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) end as b from sites) s on s.id = q.site_id""")
def urls_in_scope(spark, sf_dir):
    """Whether each queued address lies below its site's base."""
    t = _Tables(spark, sf_dir)
    j = t.queue.select("id", "site_id", "url").join(t.sites.select(F.col("id").alias("site_id"), "base_url"), "site_id")
    return j.select("id", U.in_scope(F.col("url"), F.col("base_url")).alias("in_scope"))


_ROBOTS = "User-agent: *\nDisallow: /docs/\nAllow: /docs/a # open\n\nUser-agent: Loambot\nDisallow: /book/*\n"


@query(rf"""select id, case when p = '' then '/' else p end as path,
 not (starts_with(case when p = '' then '/' else p end, '/book/')) and (starts_with(p, '/docs/a') or not starts_with(p, '/docs/')) as allowed
 from (select id, {_PATH} as p from q)""")
def robots_filter(spark, sf_dir):
    """Addresses that one robots.txt leaves open to an agent."""
    q = _Tables(spark, sf_dir).queue
    path = F.when(U.part(F.col("url"), "PATH") == "", "/").otherwise(U.part(F.col("url"), "PATH"))
    hosts = q.select(F.lower(U.part(F.col("url"), "HOST")).alias("host")).distinct().withColumn("body", F.lit(_ROBOTS))
    return R.open_urls(q, hosts, "loambot").select("id", path.alias("path"), "allowed")


@query("select url, count(*) as pages from q where url not in (select url from c) group by all")
def visited_anti_join(spark, sf_dir):
    """Queued addresses that no chunk comes from."""
    t = _Tables(spark, sf_dir)
    return t.queue.select("url").join(t.chunks.select("url").distinct(), "url", "left_anti").groupBy("url").agg(F.count("*").alias("pages"))


@query(""", n as (select count(*) as n from q), e as (select id, unnest([(2 * id) % n.n, (2 * id + 1) % n.n]) as t from q, n),
w as (select cast(1 as bigint) as node union select e.t from w join e on e.id = w.node) select node from w""")
def frontier_closure(spark, sf_dir):
    """Pages reached from page 1 over links, level by level; links are made up from ids, so that they end."""
    q = _Tables(spark, sf_dir).queue.select("id")
    n = q.count()
    link = F.explode(F.array((F.col("id") * 2) % n, (F.col("id") * 2 + 1) % n))
    edges = q.select(F.col("id").alias("src"), link.alias("dst"))
    return closure(spark.createDataFrame([(1,)], "node long"), edges).select("node")

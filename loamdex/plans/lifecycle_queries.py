"""Queries of lookups, changes and the life of a site, each with SQL for what must be there afterwards."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.api import Engine
from loamdex.config import ChunkSettings, EmbedSettings, Settings, asked
from loamdex.operators import catalog as C
from loamdex.operators import changes as D
from loamdex.operators.embed import HashingEmbedder, ServiceEmbedder, retried
from loamdex.plans.document_queries import values
from loamdex.plans.scratch import new_path
from loamdex.server import answer
from loamdex.sources.cache import drop_cached, read_cache, write_cache
from loamdex.sources.pages import FirstOf, HttpPages, MemoryPages, RenderedPages, RenderSettings, robots_text
from loamdex.sources.tables import table
from loamdex.streaming.flows import Progress, run_available

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


_NOW = "2025-06-30 00:00:00"


def _now():
    return F.to_timestamp_ntz(F.lit(_NOW))


# --- lookups


@query("select 'name and version' as by, id from sites where (name, version) = (select (name, version) from sites order by id desc limit 1) union all select 'address', id from sites where index_url = (select index_url from sites order by id desc limit 1)")
def site_by_name_or_address(spark, sf_dir):
    """The site of a name with version, and of an index address: those of the last site."""
    sites = table(spark, sf_dir, "sites")
    last = sites.orderBy(F.col("id").desc()).first()
    return C.site_by_name_version(sites, last.name, last.version).select(F.lit("name and version").alias("by"), "id").unionByName(C.site_by_index_url(sites, last.index_url).select(F.lit("address").alias("by"), "id"))


@query("select 'item' as kind, id, url from crawl_queue where id = (select min(id) from crawl_queue) group by all union all select 'chunk', id, url from indexed_chunks where id = (select min(id) from indexed_chunks) group by all union all select 'chunk of vector', id, url from indexed_chunks where vector_id = (select min(vector_id) from indexed_chunks) group by all")
def rows_by_key(spark, sf_dir):
    """A queue item and a chunk by id, and a chunk by the id of its vector: the smallest of each."""
    queue, chunks = table(spark, sf_dir, "crawl_queue"), table(spark, sf_dir, "indexed_chunks")
    least = lambda df, c: df.agg(F.min(c)).first()[0]
    found = (("item", C.queue_item(queue, least(queue, "id"))), ("chunk", C.chunk_by_id(chunks, least(chunks, "id"))), ("chunk of vector", C.chunk_by_vector(chunks, least(chunks, "vector_id"))))
    out = None
    for kind, df in found:
        df = df.select(F.lit(kind).alias("kind"), "id", "url").distinct()
        out = df if out is None else out.unionByName(df)
    return out


# --- changes


@query(f"""with n as (select index_url || 'next/' as index_url, name, version || '-next' as version from sites where id % 5 = 0), top as (select max(id) as m from sites)
select id, index_url, name, version, status, created_date from sites union all select m + row_number() over (order by index_url, name, version), index_url, name, version, 'pending', timestamp '{_NOW}' from n, top""")
def sites_inserted(spark, sf_dir):
    """The sites after new versions of some were added, and some that are there were refused."""
    sites = table(spark, sf_dir, "sites")
    some = sites.where("id % 5 = 0")
    new = some.select(F.concat("index_url", F.lit("next/")).alias("index_url"), "base_url", "name", F.concat("version", F.lit("-next")).alias("version"))
    known = some.select("index_url", "base_url", F.concat("name", F.lit(" again")).alias("name"), "version").unionByName(some.select(F.concat("index_url", F.lit("x/")).alias("index_url"), "base_url", "name", "version"))
    return D.insert_sites(sites, new.unionByName(known), _now()).select("id", "index_url", "name", "version", "status", "created_date")


@query("""select site_id, case when s = 0 and f > 0 then 'failed' else 'indexing' end as status, case when s = 0 and f > 0 then 'All ' || f || ' crawl attempts failed' when f > 0 then f || ' of ' || (s + f) || ' crawl attempts failed' end as message
 from (select site_id, count(*) filter (status = 'completed') as s, count(*) filter (status = 'failed') as f from crawl_queue where site_id is not null group by all)""")
def crawl_outcomes(spark, sf_dir):
    """What each site's crawl ends as, and the message it leaves."""
    rows = table(spark, sf_dir, "crawl_queue").where("site_id is not null")
    outcome = F.when(F.col("status") == "completed", "successful").when(F.col("status") == "failed", "failed").otherwise("robots_blocked")
    return C.crawl_outcome(C.crawl_counters(rows.select("site_id", outcome.alias("outcome")))).select("site_id", "status", "message")


@query("select 'queue' as t, count(*) as rows from crawl_queue where site_id is null or site_id <> 1 union all select 'chunks', count(*) from indexed_chunks where site_id is null or site_id <> 1")
def site_cleared(spark, sf_dir):
    """Rows left in the queue and in the chunk table without those of one site, which itself stays."""
    count = lambda t, name: D.without_site(table(spark, sf_dir, name), 1).agg(F.count("*").alias("rows")).select(F.lit(t).alias("t"), "rows")
    return count("queue", "crawl_queue").unionByName(count("chunks", "indexed_chunks"))


@query("select site_id, count(*) as rows, count(distinct id) as ids, true as was_compacted from indexed_chunks group by all")
def chunks_compacted(spark, sf_dir):
    """The chunk table after many small files were compacted to few."""
    path = new_path(spark, "small-files")
    table(spark, sf_dir, "indexed_chunks").repartition(24, "id").write.parquet(path)
    done = D.compact_small(spark, path)
    return spark.read.parquet(path).groupBy("site_id").agg(F.count("*").alias("rows"), F.countDistinct("id").alias("ids")).withColumn("was_compacted", F.lit(done))


@query("select page_id, site_id, url, title, len(sections) as sections, md5(raw_text) as hash from (select distinct on (page_id) * from extracted_pages) where page_id % 3 <> 0")
def page_cache_rows(spark, sf_dir):
    """The page cache after all pages were written to it and a third of them taken out again."""
    pages = table(spark, sf_dir, "extracted_pages").dropDuplicates(["page_id"])
    path = new_path(spark, "cache")
    write_cache(pages, path)
    left = drop_cached(spark, path, pages.where("page_id % 3 = 0"))
    assert left.schema == read_cache(spark, path).schema
    return read_cache(spark, path).select("page_id", "site_id", "url", "title", F.when(F.col("sections").isNotNull(), F.size("sections").cast("long")).alias("sections"), F.md5("raw_text").alias("hash"))


# --- streams


@query("select event_type, count(*) as events from events group by all")
def stream_resumed(spark, sf_dir):
    """Events read by a stream that was stopped after the first files and started again on its checkpoint: each once."""
    source, out, at = (new_path(spark, n) for n in ("stream-in", "stream-out", "stream-checkpoint"))
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    write = lambda k: events.where(F.pmod("event_id", F.lit(2)) == k).write.mode("append").parquet(source)
    seen: list[tuple[int, int]] = []
    listener = Progress(lambda batch, rows: seen.append((batch, rows)))
    spark.streams.addListener(listener)
    try:
        for k in (0, 1):
            write(k)
            stream = spark.readStream.schema(events.schema).parquet(source)
            run_available(stream, at, lambda df, _: df.write.mode("append").parquet(out))
        run_available(stream, at, lambda df, _: df.write.mode("append").parquet(out))  # nothing new
    finally:
        spark.streams.removeListener(listener)
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("events"))


# --- the life of a site


def _page(title: str, *links: str) -> str:
    return f"<html><head><title>{title}</title></head><body><main><h1>{title}</h1><p>All about {title} and how it is used.</p>" + "".join(f'<a href="{x}">l</a>' for x in links) + "</main></body></html>"


_SITE = {
    "https://e.example/robots.txt": "User-agent: *\nDisallow: /docs/secret",
    "https://e.example/docs/": _page("Start", "a", "b", "secret/x", "/outside", "a#part"),
    "https://e.example/docs/a": _page("Alpha routers", "b", "c", "./"),
    "https://e.example/docs/b": _page("Beta storage", "missing"),
    "https://e.example/docs/c": _page("Gamma tokens"),
    "https://e.example/docs/secret/x": _page("Secret"),
}
_MOVED = {"https://e.example/docs/": _page("Start again", "d"), "https://e.example/docs/d": _page("Delta queues")}


class _Down(HashingEmbedder):
    def validate(self) -> None:
        raise ConnectionError("refused")


def _engine(spark: SparkSession, embedder=None) -> Engine:
    folder = new_path(spark, "engine")
    settings = Settings(EmbedSettings(embedding_dimension=64), ChunkSettings(), _Folder(folder))
    return Engine(spark, settings, embedder or HashingEmbedder(64), dt.datetime(2025, 1, 1))


class _Folder(str):
    """A folder by its address, wherever it is."""

    def __truediv__(self, name: str) -> _Folder:
        return _Folder(f"{self}/{name}")


_STEPS = [
    ("added", "1 pending 1"), ("same address", "1"), ("crawled", "a b c docs/"), ("after crawl", "indexing 1 of 5 crawl attempts failed beat"), ("indexed", "4 4 completed"), ("again", "4 4"),
    ("search", "Beta storage"), ("list", "Example 4"), ("verbose", "Example 4 1"), ("status", "4 4 True ok"), ("without a vector", "1 missing"), ("cleaned", "True"), ("broken", "rebuilt 4 True"),
    ("all fail", "1 failed All 1 crawl attempts failed 4"), ("updated", "1 Delta queues, Start again 2"), ("embedder away", "not available: refused"), ("deleted", "0 0 0 0"),
]


@query(values(_STEPS, ["step", "result"]))
def engine_steps(spark, sf_dir):
    """A site from its address over crawl, index, search, repair and update to its end, with what each step left."""
    e = _engine(spark)
    steps: list[tuple[str, str]] = []
    say = lambda step, *what: steps.append((step, " ".join(map(str, what))))
    site = e.add_site("https://e.example/docs", "Example", "1.0")
    say("added", site, e.sites.first().status, e.queue.count())
    say("same address", e.add_site("https://e.example/docs/"))
    pages = e.crawl_site(site, MemoryPages(_SITE))
    say("crawled", *sorted(r.url.removeprefix("https://e.example/").removeprefix("docs/") or "docs/" for r in pages.select("url").collect()))
    row = e.sites.first()
    say("after crawl", row.status, row.error_message, "beat" if row.last_heartbeat else "none")
    e.index_site(site, pages)
    say("indexed", e.chunks.count(), e.vectors.count(), e.sites.first().status)
    e.index_site(site, pages)
    say("again", e.chunks.count(), e.vectors.count())
    say("search", e.search("Beta storage", 1, sites_filter="xamp").first().page_title)
    say("list", *(f"{r.name} {r.page_count}" for r in e.list_sites().collect()))
    say("verbose", *(f"{r.name} {r.total_chunks} {r.failed_crawl_items}" for r in e.list_verbose().collect()))
    state = e.status()
    say("status", state["chunks"], state["vectors"], state["is_consistent"], state["embedder"])
    D.swap(e.vectors.where("page_title <> 'Alpha routers'"), e._path("vectors"), ["site_id"])
    say("without a vector", e.status()["missing"], "missing")
    e.clean_up()
    say("cleaned", e.status()["is_consistent"])
    fs = spark._jvm.org.apache.hadoop.fs
    bad = fs.Path(f"{e._path('vectors')}/site_id={site}/part-broken.parquet")
    stream = bad.getFileSystem(spark._jsc.hadoopConfiguration()).create(bad)
    stream.write(bytearray(b"this is no parquet file"))
    stream.close()
    say("broken", e.repair()["vectors"], e.vectors.count(), e.status()["is_consistent"])
    e.update_site("exam", MemoryPages({}))
    row = e.sites.first()
    say("all fail", row.id, row.status, row.error_message, e.chunks.count())
    site = e.update_site("1", MemoryPages(_MOVED))
    say("updated", site, ", ".join(sorted(r.page_title for r in e.chunks.select("page_title").distinct().collect())), e.vectors.count())
    e.embedder = _Down(64)
    say("embedder away", e.status()["embedder"])
    e.delete_site("exam")
    say("deleted", e.sites.count(), e.queue.count(), e.chunks.count(), e.vectors.count())
    return spark.createDataFrame(steps, "step string, result string")


_ANSWERS = [(1, "Gamma tokens"), (2, "no site matches none"), (3, "error"), (4, "list_sites, search_docs"), (5, "Example"), (6, "error")]


@query(values(_ANSWERS, ["id", "answer"]))
def tool_answers(spark, sf_dir):
    """Answers of the tool server: a search with arguments out of bounds, one without a site, one without a query, the list of tools, a list of sites, and an unknown method."""
    e = _engine(spark)
    site = e.add_site("https://e.example/docs", "Example", "1.0")
    e.index_site(site, e.crawl_site(site, MemoryPages(_SITE)))
    call = lambda k, name, **arguments: answer(e, {"id": k, "method": "tools/call", "params": {"name": name, "arguments": arguments}})
    text = lambda reply: reply["result"]["content"][0]["text"]
    found = [
        (1, json.loads(text(call(1, "search_docs", query="Gamma tokens", limit=-3, site_id="x")))["results"][0]["page_title"]),
        (2, text(call(2, "search_docs", query="q", sites_filter="none"))),
        (3, "error" if "error" in call(3, "search_docs") else "none"),
        (4, ", ".join(sorted(t["name"] for t in answer(e, {"id": 4, "method": "tools/list"})["result"]["tools"]))),
        (5, json.loads(text(call(5, "list_sites")))["sites"][0]["name"]),
        (6, "error" if "error" in answer(e, {"id": 6, "method": "nope"}) else "none"),
    ]
    return spark.createDataFrame(found, "id int, answer string")


_SOURCES = [("two failures, then a page", "ok waits 7.0 7.0"), ("no page", "HTTP error 404"), ("spacing", "0.5, none for another host"), ("first of two", "second"), ("robots", "rules"), ("no robots", ""), ("robots out of reach", "none")]


@query(values(_SOURCES, ["case", "result"]).replace("t(case,", 't("case",'))
def page_sources(spark, sf_dir):
    """Page sources: retries, spacing, one behind another, and robots.txt where there is one, none, or no answer."""
    waits: list[float] = []
    left = [ValueError("HTTP error 500"), ValueError("connection reset")]

    def opener(url: str) -> str:
        if left:
            raise left.pop()
        return "ok"

    found = [("two failures, then a page", f"{HttpPages(spacing=0, wait=7.0, opener=opener, sleep=waits.append).get('u')} waits {' '.join(map(str, waits))}")]
    try:
        MemoryPages({}).get("u")
    except ValueError as e:
        found.append(("no page", str(e)))
    waits.clear()
    spaced = HttpPages(spacing=0.5, opener=lambda u: u, sleep=waits.append)
    for url in ("https://a.example/1", "https://b.example/1", "https://a.example/2"):
        spaced.get(url)
    found.append(("spacing", f"{waits[-1]:.1f}, none for another host" if len(waits) == 1 else str(waits)))
    found.append(("first of two", FirstOf(MemoryPages({}), MemoryPages({"u": "second"})).get("u")))
    found.append(("robots", robots_text(MemoryPages({"https://e.example/robots.txt": "rules"}), "https://e.example/a/b?c")))
    found.append(("no robots", robots_text(MemoryPages({}), "https://e.example/")))

    def away(url: str) -> str:
        raise OSError("no route")

    found.append(("robots out of reach", str(robots_text(HttpPages(retries=0, opener=away, sleep=waits.append), "https://e.example/")).lower()))
    return spark.createDataFrame(found, "case string, result string")


class _Renderer:
    """A renderer that fails at one address and counts what is running."""

    running: list[_Renderer] = []  # noqa: RUF012

    def __init__(self, settings: RenderSettings):
        self.running.append(self)

    def get(self, url: str) -> str:
        if url == "bad":
            raise OSError("no page")
        return f"<p>{url}</p>"

    def close(self) -> None:
        self.running.remove(self)


_RENDERED = [("pages", "<p>a</p> <p>b</p> <p>c</p>"), ("running", "2"), ("after a failure", "plain 1"), ("idle", "1"), ("left", "0"), ("settings", "wait must be 1 to 300, not 0")]


@query(values(_RENDERED, ["case", "result"]).replace("t(case,", 't("case",'))
def rendered_pages(spark, sf_dir):
    """A renderer before plain pages: started as needed, replaced after a failure, closed when idle; settings out of bounds."""
    now = [0.0]
    _Renderer.running = []
    source = RenderedPages(_Renderer, clock=lambda: now[0])
    found = [("pages", " ".join(source.get(u) for u in "abc")), ("running", str(len(_Renderer.running)))]
    plain = FirstOf(source, MemoryPages({"bad": "plain"})).get("bad")
    found.append(("after a failure", f"{plain} {len(_Renderer.running)}"))
    now[0] = 1000.0
    found += [("idle", str(source.close_idle())), ("left", str(len(_Renderer.running)))]
    found.append(("settings", next(RenderSettings(wait=0).problems())))
    return spark.createDataFrame(found, "case string, result string")


_SERVICE = [("batches", "2 2 1"), ("one text alone", "True"), ("has the model", "True"), ("has it not", "the service has no model other"), ("too few vectors", "1 texts, 0 vectors"), ("waits", "1.0 2.0"), ("raised at last", "ConnectionError"), ("settings", "port 8080 width 128 model m"), ("asked again", "port must be 1 to 65535, not 0"), ("written and read", "True")]


@query(values(_SERVICE, ["case", "result"]).replace("t(case,", 't("case",'))
def embedding_service(spark, sf_dir):
    """The embedding service: batches, its model, wrong answers and retries; and its settings, asked for, saved and read."""
    sent: list = []

    def send(path: str, body: dict | None) -> dict:
        if path == "/api/tags":
            return {"models": [{"name": "m"}]}
        sent.append(body["input"])
        return {"embeddings": [[0.0] * 64] * (len(body["input"]) if isinstance(body["input"], list) else 1)}

    found: list[tuple[str, str]] = []

    def message(call: Callable[[], object]) -> str:
        try:
            call()
        except Exception as e:
            return str(e)
        return "True"

    s = ServiceEmbedder(EmbedSettings(model="m", batch_size=2, embedding_dimension=64), send)
    s.embed(list("abcde"))
    found.append(("batches", " ".join(str(len(x)) for x in sent)))
    found.append(("one text alone", str(sent[-1] == "e")))
    found.append(("has the model", message(s.validate)))
    found.append(("has it not", message(ServiceEmbedder(EmbedSettings(model="other"), send).validate)))
    found.append(("too few vectors", message(lambda: ServiceEmbedder(EmbedSettings(), lambda p, b: {"embeddings": []}).embed(["a"]))))
    waits: list[float] = []

    def fails() -> None:
        raise ConnectionError("x")

    try:
        retried(fails, 3, waits.append)
    except ConnectionError as e:
        found += [("waits", " ".join(map(str, waits))), ("raised at last", type(e).__name__)]
    said: list[str] = []
    replies = iter(["", "", "0", "8080", "m", "", "128", "n"])
    got = asked(Settings(), lambda _: next(replies), said.append, test=lambda _: None)
    found.append(("settings", f"port {got.embedding.port} width {got.embedding.embedding_dimension} model {got.embedding.model}"))
    found.append(("asked again", said[0]))
    found.append(("written and read", str(Settings.parsed(got.text(), got.folder) == got)))
    return spark.createDataFrame(found, "case string, result string")

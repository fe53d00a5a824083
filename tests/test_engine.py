import datetime as dt
import io
import json

import pytest
from pyspark.sql import functions as F

from loamdex import schemas
from loamdex.__main__ import main
from loamdex.api import Engine, EngineError
from loamdex.config import ChunkSettings, EmbedSettings, Settings
from loamdex.operators import changes, search
from loamdex.operators.embed import HashingEmbedder, ServiceEmbedder, retried
from loamdex.operators.frontier import closure, crawl
from loamdex.server import answer, arguments, serve
from loamdex.sources.cache import drop_cached, read_cache, write_cache
from loamdex.sources.pages import FirstOf, HttpPages, MemoryPages, PagesDataSource, may_pass, robots_text

NOW = dt.datetime(2025, 1, 1)


def page(title, *links):
    return f"<html><head><title>{title}</title></head><body><main><h1>{title}</h1><p>All about {title} and how it is used.</p>" + "".join(f'<a href="{x}">l</a>' for x in links) + "</main></body></html>"


SITE = MemoryPages(
    {
        "https://e.com/robots.txt": "User-agent: *\nDisallow: /docs/secret",
        "https://e.com/docs/": page("Start", "a", "b", "secret/x", "/outside", "a#part"),
        "https://e.com/docs/a": page("Alpha routers", "b", "c", "./"),
        "https://e.com/docs/b": page("Beta storage", "missing"),
        "https://e.com/docs/c": page("Gamma tokens"),
        "https://e.com/docs/secret/x": page("Secret"),
    }
)


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, Settings(EmbedSettings(embedding_dimension=128), ChunkSettings(), tmp_path), HashingEmbedder(128), NOW)


def test_from_address_to_search_and_back(engine):
    site = engine.add_site("https://e.com/docs", "Example", "1.0")
    assert engine.add_site("https://e.com/docs/") == site
    with pytest.raises(EngineError):
        engine.add_site("https://other.com/", "Example", "1.0")
    with pytest.raises(EngineError):
        engine.add_site("ftp://x")
    pages = engine.crawl_site(site, SITE)
    assert {r.url: r.depth for r in pages.select("url", "depth").collect()} == {"https://e.com/docs/": 0, "https://e.com/docs/a": 1, "https://e.com/docs/b": 1, "https://e.com/docs/c": 2}
    queue = {r.url: r for r in engine.queue.collect()}
    assert queue["https://e.com/docs/missing"].status == "failed" and queue["https://e.com/docs/missing"].retry_count == 1
    engine.index_site(site, pages)
    engine.index_site(site, pages)  # nothing twice
    assert engine.chunks.count() == engine.vectors.count() == 4
    rows = engine.search("Beta storage", 2).collect()
    assert len(rows) == 2 and rows[0].page_title == "Beta storage" and rows[0].site_name == "Example" and rows[0].relevance_score >= rows[1].relevance_score
    assert engine.search("Beta", 10, sites_filter="xamp").count() == 4 and engine.search("Beta", 0, site_id=site).count() == 1
    with pytest.raises(EngineError):
        engine.search("x", sites_filter="nothing")
    assert [r.page_count for r in engine.list_sites().collect()] == [4]
    assert engine.status()["is_consistent"] and engine.list_verbose().first().failed_crawl_items == 1

    reply = answer(engine, {"id": 1, "method": "tools/call", "params": {"name": "search_docs", "arguments": {"query": "Gamma tokens", "limit": -3, "site_id": "x"}}})
    assert [r["page_title"] for r in json.loads(reply["result"]["content"][0]["text"])["results"]] == ["Gamma tokens"]
    assert answer(engine, {"id": 1, "method": "tools/call", "params": {"name": "search_docs", "arguments": {"query": "q", "sites_filter": "none"}}})["result"]["isError"]
    assert "error" in answer(engine, {"id": 2, "method": "tools/call", "params": {"name": "search_docs", "arguments": {}}})
    sink = io.StringIO()
    serve(engine, io.StringIO('{"id":1,"method":"initialize"}\n\n{"method":"x"}\n{"id":2,"method":"tools/list"}\n{"id":3,"method":"tools/call","params":{"name":"list_sites"}}\n{"id":4,"method":"nope"}\n'), sink)
    assert [json.loads(x)["id"] for x in sink.getvalue().splitlines()] == [1, 2, 3, 4]

    # A vector without chunk and a chunk without vector are found and mended.
    changes.swap(engine.vectors.where("page_title <> 'Alpha routers'").unionByName(engine.vectors.where("page_title = 'Start'").withColumn("id", F.lit("stray"))), engine._path("vectors"), ["site_id"])
    assert (engine.status()["missing"], engine.status()["orphaned"]) == (1, 1)
    engine.clean_up()
    assert engine.status()["is_consistent"] and engine.vectors.count() == 4

    assert engine.delete_site("exam") == site
    assert [engine.sites.count(), engine.queue.count(), engine.chunks.count(), engine.vectors.count()] == [0, 0, 0, 0]
    with pytest.raises(EngineError):
        engine.delete_site("exam")


def test_command_line(spark, tmp_path, capsys):
    assert main([str(tmp_path), "config"], spark) == 0 and "target_chunk_size = 640" in capsys.readouterr().out
    assert main([str(tmp_path), "add", "https://e.com/docs", "--name", "Ex"], spark, SITE) == 0
    assert main([str(tmp_path), "status"], spark) == 0 and '"chunks": 4' in capsys.readouterr().out
    assert main([str(tmp_path), "list"], spark) == 0
    assert main([str(tmp_path), "update", "1"], spark, SITE) == 0 and main([str(tmp_path), "update", "9"], spark, SITE) == 1
    assert main([str(tmp_path), "delete", "Ex"], spark) == 1 and main([str(tmp_path), "delete", "Ex", "--yes"], spark) == 0


def test_arguments():
    assert arguments({"query": "q", "limit": 0, "site_id": True, "sites_filter": 3}) == {"query": "q", "limit": 1}
    assert arguments({"query": "q", "limit": "5", "site_id": 3}) == {"query": "q", "limit": 10, "site_id": 3}


def test_top_k_cases(spark):
    df = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0]), ("d", None)], "id string, vector array<float>")
    rows = search.top_k(df, [1.0, 0.0], 2).collect()
    assert [(r.id, r.distance, r.score) for r in rows] == [("a", 0.0, 1.0), ("b", 0.0, 1.0)]
    assert search.top_k(df, [1.0, 0.0], 0).count() == 1 and search.top_k(df.limit(0), [1.0], 3).count() == 0
    with pytest.raises(Exception, match="another width"):
        search.top_k(df, [1.0], 2).collect()
    queries = df.where("id in ('a', 'c')").withColumnRenamed("id", "query_id")
    want = [("a", "a", 1), ("a", "b", 2), ("c", "c", 1), ("c", "a", 2)]
    for most in (10, 1):
        assert sorted(map(tuple, search.batch_top_k(queries, df, 2, most_queries=most).select("query_id", "id", "rank").collect())) == sorted(want)
    with pytest.raises(Exception, match="another width"):
        schemas.checked_vectors(df.where("vector is not null"), 3).collect()


def test_embedders():
    e = HashingEmbedder(16)
    a, b = e.embed(["Same text", "same TEXT"])
    assert a == b and abs(sum(x * x for x in a) - 1) < 1e-5
    sent = []

    def send(path, body):
        sent.append(body)
        if path == "/api/tags":
            return {"models": [{"name": "m"}]}
        n = len(body["input"]) if isinstance(body["input"], list) else 1
        return {"embeddings": [[0.0] * 64] * n}

    s = ServiceEmbedder(EmbedSettings(model="m", batch_size=2, embedding_dimension=64), send)
    s.validate()
    assert len(s.embed(["a", "b", "c"])) == 3 and sent[1]["input"] == ["a", "b"] and sent[2]["input"] == "c"
    with pytest.raises(ValueError):
        ServiceEmbedder(EmbedSettings(), lambda p, b: {"embeddings": []}).embed(["a"])
    with pytest.raises(ValueError):
        ServiceEmbedder(EmbedSettings(model="other"), send).validate()
    waits, calls = [], []

    def fails():
        calls.append(1)
        raise ConnectionError("x")

    with pytest.raises(ConnectionError):
        retried(fails, 3, waits.append)
    assert len(calls) == 3 and waits == [1.0, 2.0]


def test_page_sources(spark):
    seen, waits = [], []

    def opener(url):
        seen.append(url)
        if len(seen) < 3:
            raise ValueError("HTTP error 500")
        return "ok"

    assert HttpPages(spacing=0, wait=7, opener=opener, sleep=waits.append).get("u") == "ok" and waits.count(7) == 2
    with pytest.raises(ValueError):
        HttpPages(opener=lambda u: SITE.get("none"), sleep=waits.append).get("u")
    assert FirstOf(MemoryPages({}), SITE).get("https://e.com/docs/c") == SITE.get("https://e.com/docs/c")
    assert robots_text(SITE, "https://e.com/docs/a?q").startswith("User-agent") and robots_text(MemoryPages({}), "https://x.com/") == ""
    assert may_pass("Connection refused") and not may_pass("HTTP error 404")
    spark.dataSource.register(PagesDataSource)
    assert spark.read.format("pages").load().count() == 0


def test_page_cache(spark, tmp_path):
    rows = [(1, "u1", "t", [("h", "c", 2, False)], "raw", 5), (2, "u2", "t", [], "raw", 6)]
    df = spark.createDataFrame(rows, "page_id long, url string, title string, sections array<struct<heading_path:string,content:string,heading_level:tinyint,has_code_blocks:boolean>>, raw_text string, site_id long")
    path = str(tmp_path / "cache")
    write_cache(df, path)
    assert {(r.page_id, r.site_id, len(r.sections)) for r in read_cache(spark, path).collect()} == {(1, 5, 1), (2, 6, 0)}
    drop_cached(spark, path, df.where("page_id = 1"))
    assert [r.page_id for r in read_cache(spark, path).collect()] == [2]


def test_closure_ends_in_cycles(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(12)] + [(12, 0), (5, 5), (3, None)], "src long, dst long")
    got = {r.node: r.depth for r in closure(spark.createDataFrame([(0,), (0,), (None,)], "node long"), edges).collect()}
    assert got == {k: k for k in range(13)}
    assert closure(spark.createDataFrame([(0,)], "node long"), edges, 2).count() == 3


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "t")
    changes.swap(spark.range(5), path)
    changes.swap(spark.read.parquet(path).where("id > 1"), path)
    assert spark.read.parquet(path).count() == 3 and changes.compact(spark, path).count() == 3 and len(list(tmp_path.iterdir())) == 1
    queue = spark.createDataFrame([(1, 7, "u", "processing", 0, None, NOW)], schemas.CRAWL_QUEUE)
    assert changes.requeue_stale(queue, F.lit("2025-01-02").cast("timestamp_ntz")).first().status == "pending"
    urls = spark.createDataFrame([(7, "u"), (7, "v"), (None, "w")], "site_id long, url string")
    once = changes.enqueue(queue, urls, F.lit("2025-02-01").cast("timestamp_ntz"))
    assert sorted((r.url, r.status) for r in once.collect()) == [("u", "pending"), ("v", "pending")]
    assert sorted(map(tuple, changes.enqueue(once, urls, F.lit("2026-02-01").cast("timestamp_ntz")).collect())) == sorted(map(tuple, once.collect()))


def test_addresses_beyond_a_depth_stay_pending(engine):
    chain = MemoryPages({"https://e.com/docs/": page("Start", "p0"), "https://e.com/docs/p0": page("Page", "p1", "./")})
    site = engine.add_site("https://e.com/docs/", "Chain", "1.0")
    pages = engine.crawl_site(site, chain, max_depth=1)
    assert {r.url[19:] for r in pages.select("url").collect()} == {"", "p0"}
    assert [r.url[19:] for r in engine.queue.where("status = 'pending'").collect()] == ["p1"]


def test_crawl_goes_on_until_nothing_is_left(spark):
    site = [(f"https://e.com/p{k}", [f"https://e.com/p{k + 1}", "https://e.com/p0", "https://e.com/gone"]) for k in range(52)]
    table = spark.createDataFrame(site, "url string, links array<string>").coalesce(1)
    seeds = spark.createDataFrame([(1, "https://e.com/p0", "https://e.com/")], "site_id long, url string, base_url string")
    got = crawl(seeds, lambda f: f.join(F.broadcast(table), "url"), F.col("base_url"))
    assert {r.url: r.depth for r in got.select("url", "depth").collect()} == {f"https://e.com/p{k}": k for k in range(52)}
    assert got.count() == 52


def test_approximate_index(spark, tmp_path):
    rows = [(f"{k:02}", [float(k % 5), float(k // 5)]) for k in range(50)] + [("none", None), ("03", [3.0, 0.0])]
    df = spark.createDataFrame(rows, "id string, vector array<float>")
    index = search.ApproximateIndex.build(df, str(tmp_path / "i"))
    assert spark.read.parquet(str(tmp_path / "i")).count() == 51  # every row with a vector
    queries = df.where("id in ('00', '24')").withColumnRenamed("id", "query_id")
    exact = sorted(map(tuple, search.batch_top_k(queries, df.dropDuplicates(["id"]), 3).select("query_id", "id", "rank").collect()))
    index = search.ApproximateIndex.build(df.dropDuplicates(["id"]), str(tmp_path / "j"))
    assert sorted(map(tuple, index.search(queries, 3, probes=1.0).select("query_id", "id", "rank").collect())) == exact
    assert index.search(queries.limit(0), 3).count() == 0
    empty = search.ApproximateIndex.build(df.limit(0), str(tmp_path / "e"))
    assert empty.centres.shape[0] == 0


def test_scratch_needs_a_shared_folder(spark):
    from loamdex.plans import scratch

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda name, default: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077", "getConf": staticmethod(lambda: Session.conf)})  # noqa: N815

    with pytest.raises(RuntimeError):
        scratch.scratch_root(Session)
    with scratch.released(spark):
        table, n = scratch.counted(spark.range(7), "seven")
        assert n == table.count() == 7
        path = scratch._made[-1]
    assert path not in scratch._made

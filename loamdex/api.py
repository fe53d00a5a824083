"""The engine over one folder: search, lists, status and the changes that keep them."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex import schemas
from loamdex.config import Settings
from loamdex.functions import text, urls
from loamdex.functions.robots import open_urls
from loamdex.functions.text import estimated_tokens
from loamdex.operators import catalog, changes, index, reconcile, search
from loamdex.operators.embed import Embedder, HashingEmbedder
from loamdex.operators.extract import extract_pages
from loamdex.operators.frontier import crawl_levels
from loamdex.sources.pages import PageSource, fetch_pages, robots_text


class EngineError(ValueError):
    """A request that can't be met."""


class Engine:
    """Tables as Parquet snapshots below one folder; ``now`` is given, so that runs can be repeated."""

    def __init__(self, spark: SparkSession, settings: Settings, embedder: Embedder | None = None, now: dt.datetime | None = None):
        self.spark, self.settings = spark, settings
        self.embedder = embedder or HashingEmbedder(settings.embedding.embedding_dimension)
        self._now = now

    @property
    def now(self):
        return F.lit((self._now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)).isoformat(sep=" ")).cast("timestamp_ntz")

    def _path(self, name: str) -> str:
        return self.settings.vectors if name == "vectors" else f"{self.settings.catalog}/{name}"

    def _read(self, name: str, schema) -> DataFrame:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self._path(name))
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._path(name))

    sites = property(lambda self: self._read("sites", schemas.SITES))
    queue = property(lambda self: self._read("queue", schemas.CRAWL_QUEUE))
    chunks = property(lambda self: self._read("chunks", schemas.INDEXED_CHUNKS))
    vectors = property(lambda self: self._read("vectors", schemas.VECTORS))

    def search(self, query: str, limit: int = 10, site_id: int | None = None, sites_filter: str | None = None, mode: str = "contains") -> DataFrame:
        """Chunks nearest to the query, best first. ``site_id`` goes before ``sites_filter``; the filter takes all sites it matches."""
        vector = self.embedder.embed([query])[0]
        where = None
        if site_id is not None:
            where = F.col("site_id") == site_id
        elif sites_filter:
            ids = [r.id for r in catalog.matching_sites(self.sites, sites_filter, mode).select("id").collect()]
            if not ids:
                raise EngineError(f"no site matches {sites_filter}")
            where = F.col("site_id").isin(ids)
        return search.enriched(search.top_k(self.vectors, vector, limit, where), self.sites).orderBy(F.col("relevance_score").desc(), "url")

    def list_sites(self) -> DataFrame:
        return catalog.list_sites(self.sites)

    def list_verbose(self) -> DataFrame:
        return catalog.display_sites(catalog.site_statistics(self.sites, self.queue, self.chunks))

    def status(self) -> dict:
        """Sites per status, chunks, vectors, and whether the stores agree."""
        by = {r.status: r.sites for r in catalog.status_summary(self.sites).collect()}
        totals = reconcile.consistency_totals(self.consistency()).first()
        try:
            self.embedder.validate()
            embedder = "ok"
        except Exception as e:  # whatever keeps the service away is its state
            embedder = f"not available: {e}"
        return {"sites": by, "chunks": self.chunks.count(), "vectors": totals.vectors, "missing": totals.missing, "orphaned": totals.orphaned, "is_consistent": totals.is_consistent, "embedder": embedder}

    def repair(self) -> dict[str, str]:
        """Reads every table to its end. A vector table that can't be read is moved aside and built again from the chunks; a broken table of another kind is an error, since nothing else holds its rows."""
        state = {}
        for name in ("sites", "queue", "chunks", "vectors"):
            try:
                getattr(self, name).write.format("noop").mode("overwrite").save()
                state[name] = "ok"
            except Exception as e:
                if name != "vectors":
                    raise EngineError(f"table {name} can't be read: {e}") from e
                at = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name))
                aside = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._path(name)}.broken-{uuid.uuid4().hex}")
                if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).rename(at, aside):
                    raise EngineError(f"{at} can't be moved away") from e
                state[name] = "rebuilt"
        if state["vectors"] == "rebuilt":
            self.clean_up()
        return state

    def consistency(self) -> DataFrame:
        return reconcile.compared(self.sites, self.chunks, self.vectors.select("id", "site_id"))

    def clean_up(self) -> None:
        """Drops vectors without chunk and embeds chunks without vector."""
        state = self.consistency()
        kept = reconcile.without_orphans(self.vectors, state)
        again = index.embed_column(reconcile.chunks_to_embed(self.chunks, state).withColumnRenamed("chunk_content", "content").withColumnRenamed("page_title", "title"), self.embedder)
        rows = again.withColumn("token_count", estimated_tokens(F.col("content")))
        changes.swap(kept.unionByName(index.as_vectors(rows, self.now)), self._path("vectors"), ["site_id"])

    def add_site(self, url: str, name: str | None = None, version: str = "latest", base_url: str | None = None) -> int:
        """Registers a site and queues its first page; a known address gives the site it belongs to."""
        row = self.spark.range(1).select(urls.with_slash(F.lit(url.strip())).alias("index_url"))
        row = row.select("index_url", F.coalesce(F.lit(base_url), "index_url").alias("base_url"), F.trim(F.coalesce(F.lit(name), urls.default_site_name(F.col("index_url")))).alias("name"), F.lit(version).alias("version"), urls.is_web_url(F.col("index_url")).alias("ok"))
        got = row.select("*", text.valid_name(F.col("name")).alias("named"), text.valid_version(F.col("version")).alias("versioned")).first()
        if not (got.ok and got.named and got.versioned):
            raise EngineError("the address, name or version is not valid")
        known = catalog.site_by_index_url(self.sites, got.index_url).first()
        if known:
            return known.id
        new = row.select("index_url", "base_url", "name", "version")
        sites = changes.swap(changes.insert_sites(self.sites, new, self.now), self._path("sites"))
        site = catalog.site_by_index_url(sites, got.index_url).first()
        if site is None:
            raise EngineError("a site of this name and version is there already")
        self.enqueue(site.id, [got.index_url])
        return site.id

    def enqueue(self, site_id: int, addresses: Sequence[str]) -> None:
        rows = self.spark.createDataFrame([(site_id, u) for u in addresses], "site_id long, url string")
        changes.swap(changes.enqueue(self.queue, rows, self.now), self._path("queue"))

    def beat(self, site_id: int, **fields) -> None:
        """Writes a heartbeat, and other fields of the site; None empties one."""
        fields = {"last_heartbeat": self.now, **fields}
        given = self.spark.range(1).select(F.lit(site_id).cast("long").alias("id"), *((v if isinstance(v, Column) else F.lit(v)).cast(schemas.SITES[k].dataType).alias(k) for k, v in fields.items() if v is not None))
        changes.swap(changes.sparse_update(self.sites, given, clear=[k for k, v in fields.items() if v is None]), self._path("sites"))

    def crawl_site(self, site_id: int, source: PageSource, max_depth: int | None = None) -> DataFrame:
        """Fetches the site's pages level by level, records them in the queue and returns them extracted. Addresses beyond ``max_depth`` stay pending.

        Each level writes a heartbeat with the pages known so far. At the end the site is ``indexing``, with a message if
        some pages failed, or ``failed`` if all did."""
        site = catalog.site_by_id(self.sites, site_id).first()
        if site is None:
            raise EngineError(f"no site {site_id}")
        body = robots_text(source, site.index_url)
        host = site.index_url.split("/")[2].split(":")[0]
        robots = self.spark.createDataFrame([(host, body)], "host string, body string")
        seeds = self.queue.where(F.col("site_id") == site_id).select("site_id", "url", F.lit(site.base_url).alias("base_url"))
        known = 0

        def level(_: int, addresses: int) -> None:
            nonlocal known
            known += addresses
            self.beat(site_id, status="indexing", total_pages=known, error_message=None)

        pages, rest = crawl_levels(seeds, lambda f: extract_pages(fetch_pages(f, source)), F.col("base_url"), robots, max_depth=max_depth, each=level)
        queue = changes.enqueue(self.queue, pages.select("site_id", "url").unionByName(rest.select("site_id", "url")), self.now)
        done = pages.select("site_id", "url", F.when(F.col("error").isNull(), "completed").otherwise("failed").alias("status"), F.col("error").alias("error_message"))
        ids = queue.select("id", "site_id", "url").join(done, ["site_id", "url"])
        changes.swap(changes.set_status(queue, ids), self._path("queue"))
        attempts = pages.select("site_id", F.when(F.col("error").isNull(), "successful").otherwise("failed").alias("outcome"))
        ended = catalog.crawl_outcome(catalog.crawl_counters(attempts)).first()
        if ended:
            self.beat(site_id, status=ended.status, error_message=ended.message)
        return pages.where("error is null")

    def index_site(self, site_id: int, pages: DataFrame) -> None:
        """Chunks, vectors and the state of the site."""
        todo = catalog.pages_to_index(self.queue.where(F.col("site_id") == site_id), self.chunks).select("site_id", "url")
        fresh = pages.join(todo, ["site_id", "url"], "left_semi")
        index.index_pages(fresh, self._path("vectors"), self._path("chunks"), self.embedder, self.now, self.settings.chunking)
        self.beat(site_id)
        counts = catalog.crawl_progress(self.queue).select(F.col("site_id").alias("id"), "total_pages", "indexed_pages", "progress_percent")
        sites = changes.sparse_update(self.sites, counts)
        changes.swap(index.finished_sites(sites, self.queue.where(F.col("status") != "failed"), self.chunks, self.now), self._path("sites"))
        for path in (f"{self._path('vectors')}/site_id={site_id}", self._path("chunks")):
            changes.compact_small(self.spark, path)

    def update_site(self, identifier: str, source: PageSource) -> int:
        """Crawls a site again under its id. What is indexed stays if every page fails, else it is replaced."""
        site = catalog.resolve_site(self.sites, identifier).first()
        if site is None:
            raise EngineError(f"no site {identifier}")
        self.clear(site.id, "queue")
        self.enqueue(site.id, [site.index_url])
        pages = self.crawl_site(site.id, source)
        if not pages.isEmpty():
            self.clear(site.id, "chunks", "vectors")
            self.index_site(site.id, pages)
        return site.id

    def clear(self, site_id: int, *names: str) -> None:
        """Takes the site's rows out of the tables named: queue, chunks, vectors."""
        for name in names:
            changes.swap(changes.without_site(getattr(self, name), site_id), self._path(name), ["site_id"] if name == "vectors" else [])

    def delete_site(self, identifier: str) -> int:
        """The site with its queue items, chunks and vectors."""
        site = catalog.resolve_site(self.sites, identifier).first()
        if site is None:
            raise EngineError(f"no site {identifier}")
        gone = self.spark.createDataFrame([(site.id,)], "id long")
        sites, (queue, chunks, vectors) = changes.delete_sites(gone, self.sites, [self.queue, self.chunks, self.vectors])
        for name, df in (("vectors", vectors), ("chunks", chunks), ("queue", queue), ("sites", sites)):
            changes.swap(df, self._path(name), ["site_id"] if name == "vectors" else [])
        return site.id

    def allowed(self, addresses: DataFrame, robots: DataFrame, agent: str = "loamdex") -> DataFrame:
        return open_urls(addresses, robots, agent)

"""The crawl frontier as a fixpoint of levels: expand, drop what was seen, write the level to shared storage, go on."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamdex.functions.robots import open_urls
from loamdex.functions.urls import in_scope, without_fragment
from loamdex.plans.scratch import counted, materialize


#: Nodes up to which a level is broadcast to the edges (some 2 MB of numbers, 10 MB of addresses); beyond, both are shuffled.
BROADCAST_NODES = 100_000


def closure(seeds: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """node and depth of everything reached from ``seeds`` (node) over ``edges`` (src, dst), each once at its least depth; cycles end.

    Edges are written once. A level is one job: while it is small, by its counted size, it goes to the edges as a
    broadcast, and only what it reaches is shuffled."""
    edges = materialize(edges.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct(), "edges")
    level, n = counted(seeds.select("node").where("node is not null").distinct().withColumn("depth", F.lit(0)), "level")
    runs: list[tuple[int, DataFrame]] = []
    depth = 0
    while True:
        _append(runs, level, "levels")
        if not n or depth == max_depth:
            return _union(runs)
        depth += 1
        step = F.broadcast(level.select("node")) if n <= BROADCAST_NODES else level.select("node")
        reached = edges.join(step, edges["src"] == step["node"]).select(F.col("dst").alias("node")).distinct()
        level, n = counted(reached.join(_union(runs).select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), "level")


#: Tables of one size that are kept apart before they are written as one.
_RUN = 8


def _append(runs: list[tuple[int, DataFrame]], level: DataFrame, name: str) -> None:
    """Adds a level; eight tables of one size become one of the next, so that the plan stays small and a row is written again a few times only."""
    runs.append((0, level))
    while len(runs) >= _RUN and len({size for size, _ in runs[-_RUN:]}) == 1:
        size = runs[-1][0]
        runs[-_RUN:] = [(size + 1, materialize(_union(runs[-_RUN:]), name))]


def _union(runs: list[tuple[int, DataFrame]]) -> DataFrame:
    return reduce(DataFrame.unionByName, [d for _, d in runs])


def crawl(seeds: DataFrame, fetch: Callable[[DataFrame], DataFrame], base: Column, robots: DataFrame | None = None, agent: str = "loamdex", max_depth: int | None = None) -> DataFrame:
    """Pages reached from seeds (site_id, url, base_url): url, depth and what ``fetch`` gave.

    ``fetch`` takes a frontier (site_id, url, base_url) and returns the pages with their ``links``; it may read a
    table of pages or call a page source on the executors. Every address is fetched once, until none is left."""
    return crawl_levels(seeds, fetch, base, robots, agent, max_depth)[0]


def crawl_levels(seeds: DataFrame, fetch: Callable[[DataFrame], DataFrame], base: Column, robots: DataFrame | None = None, agent: str = "loamdex", max_depth: int | None = None, each: Callable[[int, int], None] | None = None) -> tuple[DataFrame, DataFrame]:
    """The pages of ``crawl``, and the frontier (site_id, url, base_url) that ``max_depth`` left unfetched. ``each`` is called before every level with its depth and number of addresses."""

    def allowed(frontier: DataFrame) -> DataFrame:
        return frontier if robots is None else open_urls(frontier, robots, agent).where("allowed").drop("allowed")

    frontier, n = counted(allowed(seeds.select("site_id", "url", "base_url").distinct()), "frontier")
    done: list[tuple[int, DataFrame]] = []
    seen: list[tuple[int, DataFrame]] = []
    depth = 0
    while True:
        if each:
            each(depth, n)
        pages = materialize(fetch(frontier).withColumn("depth", F.lit(depth)), "pages")
        _append(done, pages, "pages")
        # What was asked for counts as seen even where ``fetch`` gave no page or one of another address: else cycles don't end.
        _append(seen, frontier.select("site_id", "url").unionByName(pages.select("site_id", "url")), "seen")
        links = pages.select("site_id", "base_url", F.explode("links").alias("link")).where(in_scope(F.col("link"), base))
        fresh = links.select("site_id", without_fragment(F.col("link")).alias("url"), "base_url").distinct()
        frontier, n = counted(allowed(fresh.join(_union(seen), ["site_id", "url"], "left_anti")), "frontier")
        if not n or depth == max_depth:
            return _union(done), frontier
        depth += 1

"""robots.txt: rules of each agent, and which paths they leave open.

Rules are kept as their own rows, so that parsing and matching are plain relational steps. As in the surveyed
behaviour an empty Disallow blocks everything, an agent matches by its whole lower-case name, the last of several
User-agent lines holds, and any matching Allow of a group beats its Disallows; rules for the agent come before
those for ``*``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamdex.functions.urls import part

_RULE = "struct<agent:string,allow:boolean,pattern:string>"


def rules(robots: Column) -> Column:
    """array<struct<agent, allow, pattern>> in the order of the lines."""
    line = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    bare = F.filter(F.transform(F.split(robots, r"\r?\n", -1), line), lambda x: x.contains(":") & ~x.startswith("#"))
    value = lambda x: line(F.regexp_replace(F.regexp_replace(x, r"^[^:]*:", ""), r"#.*$", ""))
    pairs = F.transform(bare, lambda x: F.struct(F.lower(line(F.substring_index(x, ":", 1))).alias("key"), value(x).alias("value")))
    start = F.struct(F.lit(None).cast("string").alias("agent"), F.array().cast(f"array<{_RULE}>").alias("rules"))

    def step(s, x):
        rule = F.struct(s["agent"].alias("agent"), (x["key"] == "allow").alias("allow"), x["value"].alias("pattern"))
        agent = F.when(x["key"] == "user-agent", F.lower(x["value"])).otherwise(s["agent"])
        grown = F.when(x["key"].isin("allow", "disallow") & s["agent"].isNotNull(), F.concat(s["rules"], F.array(rule))).otherwise(s["rules"])
        return F.struct(agent.alias("agent"), grown.alias("rules"))

    return F.aggregate(pairs, start, step, lambda s: s["rules"])


def matches(path: Column, pattern: Column) -> Column:
    """Empty and ``/`` match all; else the path starts with the pattern, whose last ``*`` drops out."""
    return pattern.isin("", "/") | path.startswith(F.regexp_replace(pattern, r"\*$", ""))


def allowed(path: Column, of_site: Column, agent: str) -> Column:
    """Whether the rules (array as of ``rules``) leave the path open to the agent; no rules leave all open."""
    own = agent.lower()
    hit = lambda who, allow: F.exists(of_site, lambda r: (r["agent"] == who) & (r["allow"] == F.lit(allow)) & matches(path, r["pattern"]))
    decided = F.when(hit(own, True), True).when(hit(own, False), False).when(hit("*", True), True).when(hit("*", False), False)
    return F.when(of_site.isNull() | path.isNull(), True).otherwise(F.coalesce(decided, F.lit(True)))


def open_urls(urls: DataFrame, robots: DataFrame, agent: str, url: str = "url") -> DataFrame:
    """``urls`` with ``allowed``; robots: host, body (null or missing where a site has none). One rule set per host travels in the join, never one row per rule."""
    sets = robots.select(F.lower("host").alias("_host"), rules(F.col("body")).alias("_rules")).dropDuplicates(["_host"])
    path = F.when(part(F.col(url), "PATH") == "", "/").otherwise(part(F.col(url), "PATH"))
    joined = urls.withColumn("_host", F.lower(part(F.col(url), "HOST"))).join(sets, "_host", "left")
    return joined.withColumn("allowed", allowed(path, F.col("_rules"), agent)).drop("_host", "_rules")

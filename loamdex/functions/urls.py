"""URL functions as column expressions; only resolving a reference needs Python."""

from __future__ import annotations

from urllib.parse import urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Beginnings of references that lead to no other page, and the name of an index file.
_SKIPPED = r"^(mailto:|javascript:|#|\\#)"
_INDEX = r"/index\.[a-zA-Z0-9]+$"


def part(url: Column, what: str) -> Column:
    """PROTOCOL, HOST, PATH, QUERY, REF or AUTHORITY; null if it is no URL."""
    return F.try_parse_url(url, F.lit(what))


def is_web_url(url: Column) -> Column:
    """http or https with a host."""
    return F.coalesce(F.lower(part(url, "PROTOCOL")).isin("http", "https") & (part(url, "HOST") != ""), F.lit(False))


def directory(path: Column) -> Column:
    """A path as the prefix of what lies below it: a last segment with a dot is a file and drops out, any other gets a slash."""
    return F.when(path.endswith("/"), path).when(path.rlike(r"/[^/]*\.[^/]*$"), F.regexp_replace(path, r"[^/]*$", "")).otherwise(F.concat(path, F.lit("/")))


def in_scope(url: Column, base: Column) -> Column:
    """Same scheme and host, and a path below the base's directory; ports don't matter."""
    same = (F.lower(part(url, "PROTOCOL")) == F.lower(part(base, "PROTOCOL"))) & (F.lower(part(url, "HOST")) == F.lower(part(base, "HOST")))
    root = F.when(part(base, "PATH") == "", "/").otherwise(part(base, "PATH"))
    path = F.when(part(url, "PATH") == "", "/").otherwise(part(url, "PATH"))
    return F.coalesce(same & path.startswith(directory(root)), F.lit(False))


def skipped_href(href: Column) -> Column:
    """Mail, scripts and places of the same page."""
    return href.rlike(_SKIPPED)


def without_index(path: Column) -> Column:
    """``/index.ext`` at the end as a slash."""
    return F.regexp_replace(path, _INDEX, "/")


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"#.*$", "")


def with_slash(url: Column) -> Column:
    """An index address as a directory, unless its last segment has a dot."""
    bare = without_index(url)
    return F.when(bare.endswith("/") | bare.rlike(r"^[a-zA-Z]+://[^/]+/(.*/)?[^/]*\.[^/]*$"), bare).otherwise(F.concat(bare, F.lit("/")))


def robots_url(url: Column) -> Column:
    return F.concat(part(url, "PROTOCOL"), F.lit("://"), part(url, "AUTHORITY"), F.lit("/robots.txt"))


def default_site_name(url: Column) -> Column:
    """The host and the segments of the path; a slash at the end leaves a blank there."""
    path = F.regexp_replace(part(url, "PATH"), "^/", "")
    return F.when(path == "", part(url, "HOST")).otherwise(F.concat_ws(" ", part(url, "HOST"), F.array_join(F.split(path, "/", -1), " ")))


def resolve(base: str | None, href: str | None) -> str | None:
    """An absolute address of a reference found on a page: host in lower case, no default port, never an empty path."""
    if base is None or href is None:
        return None
    try:
        joined = urlsplit(urljoin(base, href.strip().replace("\\", "/")))
        if not joined.scheme or not joined.netloc:
            return None
        host, port = (joined.hostname or "").lower(), joined.port
    except ValueError:
        return None
    if not host:
        return None
    default = {"http": 80, "https": 443}.get(joined.scheme)
    where = (f"[{host}]" if ":" in host else host) + (f":{port}" if port and port != default else "")
    return urlunsplit((joined.scheme, where, joined.path or "/", joined.query, joined.fragment))


def resolved():
    """Column form of ``resolve``: a function of two columns, made when a session is there."""

    @F.pandas_udf(StringType())
    def run(base: pd.Series, href: pd.Series) -> pd.Series:
        return pd.Series([resolve(b, h) for b, h in zip(base, href, strict=True)], dtype=object)

    return run

"""Pages to documents: title, Markdown, heading sections and links, each page parsed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamdex.functions import html as H
from loamdex.functions.urls import in_scope, without_fragment
from loamdex.operators.python_columns import with_python_columns
from loamdex.schemas import SECTION

DOCUMENT = [("title", T.StringType()), ("raw_text", T.StringType()), ("sections", T.ArrayType(SECTION)), ("links", T.ArrayType(T.StringType())), ("dynamic", T.StringType())]


def extract_pages(pages: DataFrame, html: str = "html", url: str = "url", rules: dict[str, Callable] | None = None) -> DataFrame:
    """``pages`` with title, raw_text, sections, links and dynamic (why a page seems built by scripts, or null). A null page has nulls."""

    def compute(texts, urls):
        for text, address in zip(texts, urls, strict=True):
            got = H.extract(text, address, rules)
            yield tuple(got[n] for n, _ in DOCUMENT) if got else (None,) * len(DOCUMENT)

    return with_python_columns(pages, [html, url], DOCUMENT, compute)


def page_sections(documents: DataFrame, *keys: str) -> DataFrame:
    """One row per section, with its position and path."""
    return documents.select(*keys, F.posexplode("sections").alias("section_no", "s")).select(*keys, "section_no", "s.*")


def page_links(documents: DataFrame, base: Column, *keys: str) -> DataFrame:
    """Links of each page within the scope of ``base``, without fragment, once per page."""
    each = documents.select(*keys, base.alias("_base"), F.explode("links").alias("link"))
    return each.where(in_scope(F.col("link"), F.col("_base"))).select(*keys, without_fragment(F.col("link")).alias("link")).distinct()

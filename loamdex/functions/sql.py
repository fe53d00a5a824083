"""The document functions for SQL: scalar functions and table functions usable in LATERAL joins."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loamdex.config import ChunkSettings
from loamdex.functions import html as H
from loamdex.functions.chunks import chunk_page, code_in
from loamdex.functions.urls import resolved


class ChunksOf:
    """Rows of one text: chunk_index, content, token_count."""

    def eval(self, text: str, target: int, most: int):
        s = ChunkSettings(target, most, min(160, target // 4), 80)
        for c in chunk_page(None, [], text, s) if text else []:
            yield c["chunk_index"], c["content"], c["token_count"], code_in(c["content"])


class SectionsOf:
    """Rows of one HTML page: section_no, heading_path, content, has_code_blocks."""

    def eval(self, html: str):
        got = H.extract(html)
        for n, s in enumerate(got["sections"] if got else []):
            yield n, s["heading_path"], s["content"], s["has_code_blocks"]


def register(spark: SparkSession) -> None:
    """resolve_url(base, href), chunks_of(text, target, most) and sections_of(html) in the session's SQL."""
    spark.udf.register("resolve_url", resolved())
    spark.udtf.register("chunks_of", F.udtf(ChunksOf, returnType="chunk_index long, content string, token_count long, has_code boolean"))
    spark.udtf.register("sections_of", F.udtf(SectionsOf, returnType="section_no int, heading_path string, content string, has_code_blocks boolean"))

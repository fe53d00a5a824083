"""Documents to chunks, and the JVM form of the cut positions for text without code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamdex.config import ChunkSettings
from loamdex.functions.chunks import chunk_page
from loamdex.functions.text import estimated_tokens
from loamdex.operators.python_columns import with_python_columns
from loamdex.schemas import CHUNK

CHUNKS = T.ArrayType(CHUNK, False)


def chunk_documents(documents: DataFrame, settings: ChunkSettings | None = None) -> DataFrame:
    """``documents`` (title, sections, raw_text) with ``chunks``."""

    def compute(titles, sections, texts):
        for row in zip(titles, sections, texts, strict=True):
            yield (chunk_page(*row, settings),)

    return with_python_columns(documents, ["title", "sections", "raw_text"], [("chunks", CHUNKS)], compute)


def chunk_rows(chunked: DataFrame, *keys: str) -> DataFrame:
    """One row per chunk."""
    return chunked.select(*keys, F.explode("chunks").alias("c")).select(*keys, "c.*")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often the body names it; a plain projection would be merged and computed again for each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sentence_chunks(texts: DataFrame, key: str, text: str, target: int) -> DataFrame:
    """key, chunk_no, content, pieces of texts packed sentence by sentence to ``target`` tokens, all in the JVM: only token sums run through the fold, never a growing text."""
    stripped = F.transform(F.split(F.col(text), r"[.!?]", -1), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    ended = lambda p: _let(F.size(p), lambda n: F.transform(p, lambda x, i: F.when(i + 1 < n, F.concat(x, F.lit(". "))).otherwise(x)))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<int>").alias("cuts"), F.lit(0).alias("at"))

    def step(s, x):
        n = x["n"]
        cut = (s["sum"] + n > target) & (s["at"] > 0)
        return F.struct(F.when(cut, n).otherwise(s["sum"] + n).alias("sum"), F.when(cut | (s["at"] == 0), F.concat(s["cuts"], F.array(s["at"]))).otherwise(s["cuts"]).alias("cuts"), (s["at"] + 1).alias("at"))

    def chunks(p):
        """Chunks of ended sentences: between each cut and the next, or the end."""
        sized = F.transform(p, lambda x: F.struct(estimated_tokens(x).alias("n")))
        cuts = F.concat(F.aggregate(sized, start, step, lambda s: s["cuts"]), F.array(F.size(p)))

        def between(c):
            part = lambda x, i: F.slice(p, x + 1, F.element_at(c, i + 2) - x)
            return F.transform(F.slice(c, 1, F.size(c) - 1), lambda x, i: F.struct(F.regexp_replace(F.array_join(part(x, i), ""), r"(?U)^\s+|\s+$", "").alias("content"), F.size(part(x, i)).cast("long").alias("pieces")))

        return _let(cuts, between)

    found = _let(F.filter(stripped, lambda x: x != ""), lambda p: _let(ended(p), chunks))
    return texts.select(key, F.posexplode(found).alias("chunk_no", "c")).select(key, F.col("chunk_no").cast("long").alias("chunk_no"), "c.content", "c.pieces")

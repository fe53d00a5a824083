"""Encoding of a corpus with a public byte-level BPE vocabulary, by tree concatenation.

A long text is halved until its parts are short, the parts are encoded (those of very long texts as rows of their
own, on all executors), and neighbours are joined: the window around the join is encoded again and grows until
its first and last tokens are those of either side. Two properties make that exact. A sequence of BPE tokens is
the encoding of its bytes if every two neighbours are the encoding of theirs, and outside the window all
neighbours stay as they were; and the pattern that splits text before the merges looks at runs of one kind of
character and at most one character ahead, so a window that starts or ends between two tokens of a run splits
like the whole text there.

Defined cases: null and empty texts give an empty list; strings that look like special tokens are ordinary text;
rows are independent, so repeated rows and ids give one result each; an empty table gives no rows; only the two
named columns are read, whatever else the table holds.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.llm.batches import by_size
from loamdex.sources.tables import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters up to which a text is encoded in one go, and from which its parts become rows of their own.
PIECE_CHARS, SPREAD_CHARS = 8_192, 1 << 20
#: Bytes of text that are encoded at once in one Python step.
STEP_BYTES = 4 << 20


class Encoder:
    """Token ids of a text as an int32 array."""

    def __init__(self, path: str, pattern: str = PATTERN, piece_chars: int = PIECE_CHARS):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.piece_chars = piece_chars
        self._enc = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def plain(self, text: str) -> np.ndarray:
        return self._enc.encode_to_numpy(text, disallowed_special=()).astype(np.int32)

    def __call__(self, text: str) -> np.ndarray:
        if len(text) <= self.piece_chars:
            return self.plain(text)
        mid = len(text) // 2
        return self.join(self(text[:mid]), self(text[mid:]))

    def join(self, a: np.ndarray, b: np.ndarray, window: int = 8) -> np.ndarray:
        """Ids of the concatenated texts of ``a`` and ``b``."""
        if not len(a) or not len(b):
            return b if not len(a) else a
        while True:
            i, j = max(0, len(a) - window), min(len(b), window)
            while i > 0 and self._inside(a[i]):
                i -= 1
            while j < len(b) and self._inside(b[j]):
                j += 1
            if i == 0 and j == len(b):
                return self.plain(self._text(np.concatenate([a, b])))
            left, right = a[i:], b[:j]
            got = self.plain(self._text(np.concatenate([left, right])))
            keep = max(2, window // 4)
            whole_left = i == 0 or (len(left) > keep and len(got) > 2 * keep and np.array_equal(got[:keep], left[:keep]))
            whole_right = j == len(b) or (len(right) > keep and len(got) > 2 * keep and np.array_equal(got[-keep:], right[-keep:]))
            if whole_left and whole_right:
                return np.concatenate([a[:i], got, b[j:]])
            window *= 2

    def join_all(self, parts: list[np.ndarray]) -> np.ndarray:
        while len(parts) > 1:
            parts = [self.join(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0] if parts else np.zeros(0, np.int32)

    def _inside(self, token: int) -> bool:
        """Whether the token starts inside a UTF-8 character."""
        return self.bytes_of[int(token)][0] & 0xC0 == 0x80

    def _text(self, ids: np.ndarray) -> str:
        return b"".join(self.bytes_of[int(x)] for x in ids).decode("utf-8")


@lru_cache(maxsize=4)
def encoder(path: str, piece_chars: int = PIECE_CHARS) -> Encoder:
    """The encoder of this Python worker."""
    return Encoder(path, piece_chars=piece_chars)


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(x) for x in ids)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, piece_chars: int = PIECE_CHARS, spread_chars: int = SPREAD_CHARS) -> DataFrame:
    """``id_col`` and ``ids`` (array<int>) of every row of ``df``."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    long = F.coalesce(F.length("text") > spread_chars, F.lit(False))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, piece_chars)
        for batch in (part for b in batches for part in by_size(b, "text", STEP_BYTES)):
            out = _lists([enc(t) if t else np.zeros(0, np.int32) for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in batch.schema.names if n != "text"), out], [*(n for n in batch.schema.names if n != "text"), "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in by_size(b, "text", STEP_BYTES)):
            for k, text in enumerate(batch.column("text").to_pylist()):
                digest = hashlib.md5(text.encode()).hexdigest()
                for at in range(0, len(text), spread_chars):
                    yield pa.RecordBatch.from_arrays([batch.column("id").slice(k, 1), pa.array([digest]), pa.array([at]), pa.array([text[at : at + spread_chars]])], ["id", "digest", "at", "text"])

    def merge(group: pa.Table) -> pa.Table:
        """Pieces of one text; a text delivered n times under one id has each piece n times."""
        enc = encoder(path, piece_chars)
        at, ids = group.column("at").to_pylist(), group.column("ids").combine_chunks()
        copies = at.count(0)
        order = sorted(range(len(at)), key=at.__getitem__)[::copies]
        whole = enc.join_all([ids[k].values.to_numpy(zero_copy_only=False) for k in order])
        return pa.table({"id": pa.array([group.column("id")[0].as_py()] * copies, group.schema.field("id").type), "ids": _lists([whole] * copies)})

    short = rows.where(~long).mapInArrow(encode, f"id {kind}, ids array<int>")
    pieces = rows.where(long).mapInArrow(cut, f"id {kind}, digest string, at bigint, text string").repartition("id", "digest", "at")
    spread = pieces.mapInArrow(encode, f"id {kind}, digest string, at bigint, ids array<int>").groupBy("id", "digest").applyInArrow(merge, f"id {kind}, ids array<int>")
    return short.unionByName(spread).select(F.col("id").alias(id_col), "ids")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode_texts(table(spark, sf_dir, "documents"))


QUERIES = {"p6_ids": p6_ids}
ORACLES: dict[str, str] = {}

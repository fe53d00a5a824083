"""Language of each text and of each part of a mixed text.

A text is cut into blocks (runs of non-blank lines). Code, identifiers, addresses and quotations are left out; what
remains are words. The script of a word narrows its candidate languages (those whose samples use the script);
each word then has a score per candidate, log of a mixture of its relative frequency in the language and of a
character trigram model, without accents and letter case. Viterbi over the words of every text, with all languages
as states and a penalty for switching, small between blocks and large inside one, labels spans: the spans
themselves are one output, wherever they begin (``language_spans``); in the other a block has the language of
most of its words and runs of such blocks are segments (``language_segments``). All texts of a step take their
first word at once, then their second, and so on, so that a step over words is a few array operations.

The model is fitted on ``lang_samples`` and then on a bounded sample of labelled documents (``SAMPLE`` documents,
taken by a hash of their ids, ``SAMPLE_CHARS`` characters of each): their blocks count where the label and the
first model agree, so wrong labels don't. Everything else runs over whole texts of all documents.

Confidence is the probability of the label against the next best language under a tempered model.

Defined cases: null and empty texts, and those without prose (fewer than two words), have no segment; blocks
without prose belong to the segment before them, at the start to the first; an unclosed code fence ends with its
block; line ends may be of any kind; null ids are kept; repeated rows give repeated results; empty tables give
no rows; only the named columns are read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.llm.batches import by_size
from loamdex.sources.tables import table

SAMPLE, SAMPLE_CHARS = 2_000, 20_000
#: Penalties in nats for a switch between two words of one block, and of two.
INSIDE, BETWEEN = 12.0, 4.0
#: Share of the character model in a word's score, and the most that one word can say against a language.
BACKOFF, MOST = 0.1, 7.0
LEAST_WORDS = 2
#: Bytes of text that go through Viterbi at once in one Python step.
STEP_BYTES = 4 << 20

# Starts of the Unicode ranges told apart here, and what each range holds.
_RANGES = [(0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "other"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x31F0, "kana"), (0x3200, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB07, "other"), (0xFF21, "latin"), (0xFF5B, "other"), (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han")]
_STARTS = [s for s, _ in _RANGES]

_LINE_END = re.compile(r"\r\n|\r|\n")
_FENCE = re.compile(r"\s*(```|~~~)")
#: Code spans, quotations, tags, escapes and addresses; every alternative starts with a character that is rare in prose.
_NOT_PROSE = re.compile(
    r"`[^`]*`"
    r"|“[^”“]*[”“]|„[^“”„]*[“”]|«[^»]*»|»[^«]*«|「[^」]*」|『[^』]*』|\"[^\"\n]*\""
    r"|&\w+;|</?\w[^>\n]*>|\[[A-Z]{2,}\]|\\\w+|\]\([^)\n]*\)|--[\w-]+"
)
#: A word, or a longer run that is an identifier or address as a whole.
_RUN = re.compile(r"\w+(?:://\S+|(?:(?:::|\.)\w+)*)")
_CAMEL = re.compile(r"[a-z]+[A-Z]|(?:[A-Z][a-z]+){2}")
_FOLD = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i"})


def prose_words(text: str) -> list[str]:
    """Words of letters, without identifiers."""
    found = [w for w in _RUN.findall(_NOT_PROSE.sub(" ", text)) if w.isalpha()]
    return [w for w in found if w.islower() or w.istitle() or w.isupper() or not _CAMEL.match(w)]


def script(ch: str) -> str:
    return _RANGES[bisect_right(_STARTS, ord(ch)) - 1][1]


def folded(word: str) -> str:
    """Without letter case and accents."""
    word = word.lower()
    if word.isascii():
        return word
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c)).translate(_FOLD).lower()


def blocks_of(text: str) -> list[list[str]]:
    """The words of prose of each block."""
    blocks: list[list[str]] = []
    lines: list[str] = []
    fenced: list[int] = []  # blocks inside an open fence
    kept: list[str | None] = []
    open_at = None
    for line in [*_LINE_END.split(text), ""]:
        if not line.strip():
            if lines:
                kept.append("\n".join(lines))
                if open_at is not None:
                    fenced.append(len(kept) - 1)
                lines = []
            continue
        if _FENCE.match(line):
            if open_at is None:
                open_at = len(kept)
                lines.append("\0")  # what follows in this block is code
            else:
                if open_at == len(kept):
                    while lines.pop() != "\0":
                        pass
                else:
                    for k in fenced:
                        kept[k] = kept[k].split("\0")[0] if k == open_at and kept[k] else ""
                    lines = []
                open_at, fenced = None, []
                lines.append(" ")
            continue
        lines.append(line)
    for b in kept:
        blocks.append(prose_words(b.split("\0")[0]) if b else [])
    return blocks


class Model:
    """Scores of words for each language."""

    def __init__(self, texts: dict[str, list[list[str]]]):
        self.langs = sorted(texts)
        counts = {lang: Counter(folded(w) for words in texts[lang] for w in words) for lang in self.langs}
        letters = {lang: Counter(script(ch) for w in c.elements() for ch in w) for lang, c in counts.items()}
        used = {lang: {s for s, n in x.items() if n >= 0.1 * sum(x.values())} for lang, x in letters.items()}
        self.by_script = {s: [k for k, lang in enumerate(self.langs) if s in used[lang]] for s in {r for _, r in _RANGES}}
        total = {lang: max(1, sum(c.values())) for lang, c in counts.items()}
        self.words: dict[str, list[float]] = defaultdict(lambda: [0.0] * len(self.langs))
        self.grams: list[dict[str, int]] = []
        for k, lang in enumerate(self.langs):
            grams: Counter[str] = Counter()
            for w, n in counts[lang].items():
                self.words[w][k] = n / total[lang]
                n, v = min(n, 20), f"  {w} "
                for i in range(2, len(v)):
                    for size in (3, 2, 1):
                        grams[v[i - size + 1 : i + 1]] += n
                    grams["/" + v[i - 2 : i]] += n
                    grams["/" + v[i - 1]] += n
                    grams["/"] += n
            self.grams.append(dict(grams))
        self.words = dict(self.words)

    def spelled(self, word: str, k: int) -> float:
        """Probability of the word's letters, trigrams backed by bigrams backed by letters."""
        g, v, p = self.grams[k], f"  {word} ", 0.0
        for i in range(2, len(v)):
            one = (g.get(v[i], 0) + 0.5) / (g.get("/", 0) + 30)
            two = (g.get(v[i - 1 : i + 1], 0) + 3 * one) / (g.get("/" + v[i - 1], 0) + 3)
            p += math.log((g.get(v[i - 2 : i + 1], 0) + 3 * two) / (g.get("/" + v[i - 2 : i], 0) + 3))
        return math.exp(p)

    def score(self, word: str) -> np.ndarray:
        """Per language, at most 0 and at least -MOST; 0 for all where the word says nothing."""
        s = script(word[0])
        candidates = self.by_script.get(s) or range(len(self.langs))
        out = np.full(len(self.langs), -MOST, np.float32)
        w = folded(word)
        if len(candidates) == 1:
            out[candidates[0]] = 0
            return out
        seen = self.words.get(w)
        for k in candidates:
            out[k] = math.log((1 - BACKOFF) * (seen[k] if seen else 0) + BACKOFF * self.spelled(w, k) + 1e-30)
        best = max(out[k] for k in candidates)
        for k in range(len(out)):
            out[k] = max(out[k] - best, -MOST) if k in candidates else -MOST
        return out


class Labeller:
    """A model with the scores of the words met so far."""

    def __init__(self, model: Model):
        self.model = model
        self.single: dict[str, int] = {}
        self.size = 0
        self.rows = np.zeros((1 << 12, len(model.langs)), np.float32)
        for s, c in model.by_script.items():
            if len(c) == 1:
                row = np.full(len(model.langs), -MOST, np.float32)
                row[c[0]] = 0
                self.single[s] = self._add(row)
        self.fixed = self.size
        self.known: dict[str, int] = {}

    def _add(self, row: np.ndarray) -> int:
        if self.size == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[self.size] = row
        self.size += 1
        return self.size - 1

    def ids(self, words: list[str]) -> list[int]:
        known, out = self.known, []
        for w in words:
            i = known.get(w)
            if i is None:
                if w[0] > "ͯ" and (i := self.single.get(script(w[0]))) is not None:
                    out += [i] * ((len(w) + 2) // 3)  # no blanks between words: three letters count as one
                    continue
                i = known[w] = self._add(self.model.score(w))
            out.append(i)
        return out

    def words_of(self, text: str | None) -> list[list[int]]:
        """The word ids of each block, no list of blocks if there is too little prose."""
        if text and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        ids = [self.ids(b) if b else b for b in blocks_of(text)] if text else []
        return ids if sum(map(len, ids)) >= LEAST_WORDS else []

    def labelled(self, texts: list[str | None]) -> Iterator[tuple[int, list[list[int]], np.ndarray, np.ndarray]]:
        """Of each text with prose its position, word ids by block, and for each word its scores and its language on the best path."""
        if len(self.known) > 300_000:  # between steps only, so that the rows of one step stay
            self.known, self.size = {}, self.fixed
        found = [(k, ids) for k, text in enumerate(texts) if (ids := self.words_of(text))]
        if not found:
            return
        sizes = [[len(b) for b in ids] for _, ids in found]
        words = self.rows[np.fromiter((i for _, ids in found for b in ids for i in b), np.int64)]
        penalty = np.full(len(words), INSIDE, np.float32)
        heads = np.cumsum([0, *(n for x in sizes for n in x)])[:-1]
        penalty[heads[[n > 0 for x in sizes for n in x]]] = BETWEEN
        lengths = np.array([sum(x) for x in sizes])
        starts = np.cumsum([0, *lengths[:-1]])
        penalty[starts] = 0
        path = best_path(words, penalty, starts, lengths)
        for (k, ids), start, n in zip(found, starts.tolist(), lengths.tolist(), strict=True):
            yield k, ids, words[start : start + n], path[start : start + n]

    def segments(self, texts: list[str | None]) -> list[list[tuple[int, int, str, float]]]:
        """For each text first and last block, language and confidence of each segment."""
        out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
        width = len(self.model.langs)
        for k, ids, words, path in self.labelled(texts):
            at = [n for n, b in enumerate(ids) if b]
            sizes = [len(ids[n]) for n in at]
            starts = np.cumsum([0, *sizes[:-1]])
            votes = np.bincount(np.repeat(np.arange(len(at)), sizes) * width + path, minlength=len(at) * width).reshape(-1, width)
            labels = votes.argmax(axis=1)
            sums = np.add.reduceat(words, starts, axis=0)
            first = np.flatnonzero(np.concatenate([[True], labels[1:] != labels[:-1]]))
            blocks = [0, *(at[n] for n in first[1:]), len(ids)]
            for n, (label, s) in enumerate(zip(labels[first], np.add.reduceat(sums, first, axis=0), strict=True)):
                out[k].append((blocks[n], blocks[n + 1] - 1, self.model.langs[label], confidence(s, label)))
        return out

    def spans(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int, str, float]]]:
        """For each text block and word of the block at which a span begins and at which it ends, language and confidence of each span of the best path."""
        out: list[list[tuple[int, int, int, int, str, float]]] = [[] for _ in texts]
        for k, ids, words, path in self.labelled(texts):
            where = np.array([(n, j) for n, b in enumerate(ids) for j in range(len(b))])
            first = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
            ends = [*(first[1:] - 1), len(path) - 1]
            for a, b, s in zip(first, ends, np.add.reduceat(words, first, axis=0), strict=True):
                out[k].append((*where[a].tolist(), *where[b].tolist(), self.model.langs[path[a]], confidence(s, path[a])))
        return out


def confidence(scores: np.ndarray, label: int) -> float:
    """Probability of the label against the next best language under a tempered model."""
    rest = np.delete(scores, label).max(initial=-1e9)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, 0.3 * float(scores[label] - rest)))))


def best_path(scores: np.ndarray, penalty: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The state of every word on the best path of its text. Texts lie end to end, none is empty; ``penalty`` is that of a switch before a word."""
    order = np.argsort(-lengths, kind="stable")
    begin, size = starts[order], lengths[order]
    active = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")  # texts with more than t words
    value = np.zeros((len(order), scores.shape[1]), np.float32)
    stays = np.empty(scores.shape, bool)
    best = np.empty(len(scores), np.int16)
    for t, n in enumerate(active.tolist()):
        at, v = begin[:n] + t, value[:n]
        top = v.argmax(axis=1)
        switched = v[np.arange(n), top] - penalty[at]
        stay = v >= switched[:, None]
        stays[at], best[at] = stay, top
        value[:n] = np.where(stay, v, switched[:, None]) + scores[at]
    path = np.empty(len(scores), np.int64)
    q = value.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = begin[:n] + t
        path[at] = q[:n]
        q[:n] = np.where(stays[at, q[:n]], q[:n], best[at])
    return path


def fit(samples: list[tuple[str, str]], labelled: list[tuple[str, str]]) -> Model:
    """samples: language and text, certain; labelled: language and text, some wrong."""
    texts: dict[str, list[list[str]]] = defaultdict(list)
    for lang, text in samples:
        texts[lang] += [b for b in blocks_of(text or "") if b]
    if not texts:
        return Model({})
    first = Labeller(Model(texts))
    more = {lang: list(x) for lang, x in texts.items()}
    for at in range(0, len(labelled), 256):
        some = [(lang, text) for lang, text in labelled[at : at + 256] if lang in more]
        for (lang, text), segments in zip(some, first.segments([text for _, text in some]), strict=True):
            agreed = [x for x in segments if x[2] == lang and x[3] > 0.9]
            blocks = blocks_of(text) if agreed else []
            for start, end, _, _ in agreed:
                more[lang] += [b for b in blocks[start : end + 1] if b]
    return Model(more)


def plain_label(label: Column) -> Column:
    """Without letter case and outer white space."""
    return F.regexp_replace(F.lower(label), r"(?U)^\s+|\s+$", "")


def names_language(label: Column, lang: Column, codes: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with ``agrees``: whether the label names the language, by code, code3, English name or code and region."""
    spelled = codes.select(F.lower(F.trim("code")).alias("_code"), F.lower(F.trim("code3")).alias("_code3"), F.lower(F.trim("english_name")).alias("_name")).dropDuplicates(["_code"])
    p = plain_label(label)
    joined = rows.join(spelled, lang == F.col("_code"), "left")
    agrees = (p == F.col("_code")) | (p == F.col("_code3")) | (p == F.col("_name")) | (p.rlike("^[a-z]+[-_][a-z0-9]+$") & (F.regexp_extract(p, "^([a-z]+)[-_]", 1) == F.col("_code")))
    return joined.withColumn("agrees", F.coalesce(agrees, F.lit(False))).drop("_code", "_code3", "_name")


def fitted(documents: DataFrame, samples: DataFrame, codes: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from the samples and from at most ``sample`` labelled documents."""
    p = plain_label(F.col("lang"))
    spelled = {}
    for r in codes.collect():  # one row a language
        for x in (r.code, r.code3, r.english_name):
            if x:
                spelled[x.strip().lower()] = r.code
    known = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", p.alias("label"))
    region = F.regexp_replace("label", "[-_][a-z0-9]+$", "")
    chosen = known.where(region.isin(list(spelled))).select("doc_id", F.xxhash64(F.lit(5), "doc_id").alias("h")).orderBy("h", "doc_id").limit(sample).select("doc_id")
    ids = [r.doc_id for r in chosen.collect()]  # at most ``sample``
    rows = documents.where(F.col("doc_id").isin(ids)).select("doc_id", p.alias("label"), F.substring("text", 1, SAMPLE_CHARS).alias("text")).limit(2 * sample).collect() if ids else []
    labelled = [(spelled.get(re.sub("[-_][a-z0-9]+$", "", r.label)) or spelled.get(r.label, ""), r.text) for r in sorted(rows, key=lambda r: (r.doc_id, r.text))]
    certain = [(r.lang, r.sample_text) for r in samples.where("lang is not null and sample_text is not null").orderBy("sample_id").collect()]  # all of them
    return fit(certain, labelled)


def _labelled(documents: DataFrame, model: Model, id_col: str, text_col: str, how: str, fields: dict[str, pa.DataType]) -> DataFrame:
    """id, label (the column lang), number of the part and of all parts of the text, and ``fields`` of every part that ``how`` of the labeller gives."""
    kind = documents.schema[id_col].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast(model)  # its words are those of the bounded sample
    names = ["id", "label", "segment_no", "segments", *fields]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not shared.value.langs:
            return
        labeller = Labeller(shared.value)
        for batch in (part for b in batches for part in by_size(b, "text", STEP_BYTES)):
            out = [(k, n, len(found), *s) for k, found in enumerate(getattr(labeller, how)(batch.column("text").to_pylist())) for n, s in enumerate(found)]
            if out:
                k, *columns = zip(*out, strict=True)
                at = pa.array(k, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("label").take(at), *(pa.array(c, t) for c, t in zip(columns, [pa.int32(), pa.int32(), *fields.values()], strict=True))], names)

    rows = documents.select(F.col(id_col).alias("id"), F.col("lang").alias("label"), F.col(text_col).alias("text"))
    types = {pa.int32(): "int", pa.string(): "string", pa.float64(): "double"}
    out = rows.mapInArrow(label, f"id {kind}, label string, segment_no int, segments int, " + ", ".join(f"{n} {types[t]}" for n, t in fields.items()))
    return out.withColumnRenamed("id", id_col)


def language_segments(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, label (the column lang), segment_no, segments, block_no (its first), last_block, lang and confidence of every segment."""
    fields = {"block_no": pa.int32(), "last_block": pa.int32(), "lang": pa.string(), "confidence": pa.float64()}
    return _labelled(documents, model, id_col, text_col, "segments", fields)


def language_spans(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``language_segments``, with the word of the block (from 0, words of prose; three letters of a script without blanks count as one) at which a span begins and ends: spans may begin inside a block."""
    fields = {"block_no": pa.int32(), "word_no": pa.int32(), "last_block": pa.int32(), "last_word": pa.int32(), "lang": pa.string(), "confidence": pa.float64()}
    return _labelled(documents, model, id_col, text_col, "spans", fields)


def _model(spark: SparkSession, sf_dir: str) -> Model:
    return fitted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "lang_samples"), table(spark, sf_dir, "lang_codes"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of texts in several languages, and the segment of other texts whose label doesn't name their language."""
    rows = names_language(F.col("label"), F.col("lang"), table(spark, sf_dir, "lang_codes"), language_segments(table(spark, sf_dir, "documents"), _model(spark, sf_dir)))
    return rows.where((F.col("segments") > 1) | ~F.col("agrees")).select("doc_id", F.col("block_no").cast("long").alias("block_no"), "lang")


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment of every text with its language and confidence."""
    return language_segments(table(spark, sf_dir, "documents"), _model(spark, sf_dir))


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span of every text with its language and confidence, also where the language changes inside a block."""
    return language_spans(table(spark, sf_dir, "documents"), _model(spark, sf_dir))


QUERIES = {"p8_found": p8_found, "p8_segments": p8_segments, "p8_spans": p8_spans}
ORACLES: dict[str, str] = {}

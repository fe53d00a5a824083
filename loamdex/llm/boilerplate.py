"""Main content of web pages: removal of what a host's pages share, by hashed element subtrees.

A page in Markdown is a tree: sections under headings, in them lists and lines, in lines links, separated leaves,
labels and quotations. Subtrees are hashed bottom-up, without letter case, amount of white space and digits, the
page's own title masked. A subtree whose whole content recurs has lines that recur, so whole contents are hashed
by line; inner elements are hashed with their fixed content kept and what varies masked:

* a section that begins with a list of links: its heading and the kinds of links (own page or other pages);
* a list of links to headings of its own page;
* a line: its labels; arrows at its ends; the first of its separated leaves where the last is the page's title; the
  words around a quotation.

Hashes are counted per host by distinct pages. A subtree with a hash on at least ``least_pages`` pages of its host
and on ``least_share`` of them (whole sentences: ``sentence_share``) is template, and all its lines go. So a line goes if its content recurs, or if it
fills a place in an element whose fixed content recurs; position or form alone never decides.

Body by definition, and never deleted: code (fences and lines with code spans), tables, the title, headings that
don't recur with a list of links below them. A whole sentence that pages share is also how notes and prerequisites look: it
is template only before the title or after the last line that stays for other reasons.

A host may hold a third of all pages, and its footer is on each of them: counts are combined before the shuffle,
and the join back to the elements is salted.

Defined cases: null and empty texts have no lines; a page without a known site counts to the host of its address;
rows repeated with one page id count as one page; an unclosed fence is code to the end; null page ids are
dropped; empty tables give no rows; only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.llm.batches import by_size
from loamdex.llm.repeated_lines import website
from loamdex.plans.scratch import materialize
from loamdex.sources.tables import table

SALTS = 16
#: Characters of Markdown read at once in one Python step.
STEP_CHARS = 4 << 20

_SPACE, _DIGITS = re.compile(r"\s+"), re.compile(r"[0-9]+")
_FENCE = re.compile(r"\s*(?:```|~~~)")
_ITEM = re.compile(r"(?:[-*+•]|[0-9]+[.)])\s+(.*)$")
# Possessive, and without a bracket inside: long lines of brackets take linear time.
_LINK_ONLY = re.compile(r"\[([^\]]*+)\]\(([^)\s]*+)[^)]*+\)$")
_LINK = re.compile(r"\[([^\[\]]*+)\]\([^()]*+\)")
_HEADING = re.compile(r"(#{1,6})\s+(.*)$")
_QUOTE = re.compile(r"[“\"«„][^“”\"«»„]+[”\"»“]")
_LABEL = re.compile(r"(?:^|(?<=\s))[^\W\d_]+:(?=\s)")
_BACK, _ON = "←⟵", "→⟶"
_BETWEEN = re.compile(r"\s(?:[›»«←→⟵⟶|·>/]|[–—-])\s")


def plain(line: str) -> str:
    return _DIGITS.sub("0", _SPACE.sub(" ", line).strip().lower())


def masked(text: str, own: str) -> str | None:
    """A line with its fixed content kept and what varies as ``*``; None if nothing says what is fixed. ``text`` is plain, ``own`` the page's plain title."""
    if text.startswith(("|", "#")) or "`" in text:
        return None
    bare = _LINK.sub(r"\1", text)
    if own:
        bare = bare.replace(own, "\0")
    quote = _QUOTE.search(bare)
    if quote:
        around = [*bare[: quote.start()].split()[-4:], "*", *bare[quote.end() :].split()[:4]]
        return "quote " + " ".join(around) if len(around) > 3 else None
    if not bare or bare[-1] in ".!?:;,":
        return None
    labels = _LABEL.findall(bare)
    if labels and bare.startswith(labels[0]):
        return "labels " + " * ".join(labels)
    back, on = bare[0] in _BACK, bare[-1] in _ON
    if back or on:
        return f"ends {bare[0] if back else '*'} {bare[-1] if on else '*'}"
    leaves = _BETWEEN.split(bare)
    return f"trail {leaves[0]} * title" if len(leaves) > 2 and leaves[-1] == "\0" else None


def elements(text: str, title: str | None) -> tuple[int, list[int], list[tuple[int, list[tuple[str, bool]]]]]:
    """Line of the title (-1 if there is none), all non-blank lines, and the keys of every line that can be template; a key with whether it is that of a whole sentence."""
    seen: list[tuple[int, str, str]] = []  # line_no, kind, plain text
    fenced = False
    for no, line in enumerate(text.split("\n")):
        if _FENCE.match(line):
            fenced = not fenced
            seen.append((no, "code", ""))
        elif fenced:
            if line.strip():
                seen.append((no, "code", ""))
        elif p := plain(line):
            seen.append((no, "heading" if _HEADING.match(p) else "line", p))
    headings = {_HEADING.match(p).group(2): k for k, (_, kind, p) in reversed(list(enumerate(seen))) if kind == "heading"}
    own = plain(title or "")
    first = headings.get(own)
    if first is None:
        first = next((k for k, (_, kind, p) in enumerate(seen) if kind == "heading" and p.startswith("# ")), None)
        if first is not None:
            own = own or seen[first][2].lstrip("# ")
    out: list[tuple[int, list[tuple[str, bool]]]] = []
    roots: list[str] = []  # hashes of the elements above the list that is open
    for k, (no, kind, p) in enumerate(seen):
        if kind == "code" or k == first:
            roots = []
            continue
        links = [] if kind == "line" and roots else _links(seen, k + 1 if kind == "heading" else k)
        if kind == "heading":
            roots = [f"section {p.lstrip('# ')} {''.join(sorted({to for _, to in links}))}"] if links else []
        elif links:
            roots = [""]
        elif roots and not _link_item(p):
            roots = []
        if links and all(name in headings for name, _ in links):
            roots.append("list of own headings")
        keys = [(r, False) for r in roots if r]
        if kind == "line":
            if "`" not in p and not p.startswith("|"):
                keys.append(("line " + (p.replace(own, "\0") if len(own) > 8 else p), p.endswith(".")))
            if form := masked(p, own):
                keys.append((form, False))
        if keys:
            out.append((no, keys))
    return seen[first][0] if first is not None else -1, [no for no, _, _ in seen], out


def _link_item(p: str) -> re.Match | None:
    item = _ITEM.match(p)
    return _LINK_ONLY.match(item.group(1)) if item else None


def _links(seen: list[tuple[int, str, str]], start: int) -> list[tuple[str, str]]:
    """Names and kinds (own page or other) of the links of the list that begins at ``start``."""
    found = []
    for _, kind, p in seen[start:]:
        link = _link_item(p) if kind == "line" else None
        if not link:
            break
        found.append((link.group(1), "own" if link.group(2).startswith("#") else "other"))
    return found


def page_hosts(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """host, page_id, title, raw_text of the cached pages."""
    known = sites.where("id is not null").select(F.col("id").alias("site_id"), website(F.col("base_url")).alias("site")).dropDuplicates(["site_id"])
    joined = pages.where("page_id is not null and raw_text is not null").select("page_id", "site_id", "url", "title", "raw_text").join(known, "site_id", "left")
    authority = F.regexp_extract(F.lower("url"), "^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    return joined.select(F.coalesce("site", authority, F.lit("")).alias("host"), "page_id", "title", "raw_text")


def template_lines(pages: DataFrame, least_pages: int = 3, least_share: float = 0.01, sentence_share: float = 0.12) -> DataFrame:
    """page_id, line_no of every template line; pages: host, page_id, title, raw_text."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in by_size(b, "raw_text", STEP_CHARS)):
            host, page, line, key, filled = [], [], [], [], []
            columns = (batch.column(n).to_pylist() for n in ("host", "page_id", "title", "raw_text"))
            for h, p, title, text in zip(*columns, strict=True):
                seed = xxhash.xxh64_intdigest(h)
                top, lines, found = elements(text, title)
                rows = [(-1, top, lines), *((no, (xxhash.xxh64_intdigest(k, seed=seed) - (1 << 63)) & ~1 | sentence, None) for no, keys in found for k, sentence in keys)]
                host += [seed - (1 << 63)] * len(rows)
                page += [p] * len(rows)
                for no, k, x in rows:
                    line.append(no)
                    key.append(k)
                    filled.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.int64()), pa.array(page, pa.int64()), pa.array(line, pa.int32()), pa.array(key, pa.int64()), pa.array(filled, pa.list_(pa.int32()))], ["host", "page_id", "line_no", "key", "filled"])

    # One row a page has line_no -1, the line of the title as key, and the lines that aren't blank.
    found = pages.select("host", F.col("page_id").cast("long").alias("page_id"), "title", "raw_text").mapInArrow(parse, "host long, page_id long, line_no int, key long, filled array<int>")
    found = materialize(found, "elements")
    page = found.where("line_no = -1")
    counted = found.where("line_no >= 0").select("host", "key", "page_id").distinct().groupBy("host", "key").agg(F.count("*").alias("pages"))
    size = page.select("host", "page_id").distinct().groupBy("host").agg(F.count("*").alias("size"))
    shared = counted.where(F.col("pages") >= least_pages).join(size, "host").where(F.col("pages") >= F.col("size") * F.when(F.col("key").bitwiseAND(1) == 1, sentence_share).otherwise(least_share)).select("host", "key")
    salted = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = found.where("line_no >= 0").drop("filled").withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    hits = rows.join(salted, ["host", "key", "salt"], "left_semi")
    no_lines = F.lit(None).cast("array<int>")
    both = hits.select("page_id", "line_no", F.col("key").bitwiseAND(1).cast("int").alias("sentence"), no_lines.alias("filled"), F.lit(None).cast("int").alias("top"))
    both = both.unionByName(page.select("page_id", F.lit(None).cast("int").alias("line_no"), F.lit(None).cast("int").alias("sentence"), "filled", F.col("key").cast("int").alias("top")))
    of = both.groupBy("page_id").agg(
        F.collect_set(F.when(F.col("line_no").isNotNull(), F.struct("line_no", "sentence"))).alias("hits"), F.max(F.when(F.col("filled").isNotNull(), F.struct("top", "filled"))).alias("page")
    )
    lines = F.array_distinct(F.transform("hits", lambda x: x["line_no"]))
    sure = F.transform(F.filter("hits", lambda x: x["sentence"] == 0), lambda x: x["line_no"])
    of = of.select("page_id", F.col("page.top").alias("top"), lines.alias("lines"), sure.alias("sure"), F.coalesce(F.array_max(F.array_except("page.filled", lines)), F.lit(-1)).alias("last"))
    gone = F.filter("lines", lambda n: F.array_contains("sure", n) | (n < F.col("top")) | (n > F.col("last")))
    return of.select("page_id", F.explode(gone).alias("line_no"))


def main_content(pages: DataFrame, template: DataFrame) -> DataFrame:
    """page_id and body: raw_text without its template lines; a page id once."""
    gone = template.groupBy("page_id").agg(F.collect_list("line_no").alias("gone"))
    once = pages.where("page_id is not null").select("page_id", "raw_text").dropDuplicates(["page_id"]).join(gone, "page_id", "left")
    lines = F.transform(F.split("raw_text", "\n", -1), lambda line, i: F.named_struct(F.lit("i"), i, F.lit("line"), line))
    kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains("gone", x["i"]), F.lit(False)))
    body = F.array_join(F.transform(kept, lambda x: x["line"]), "\n")
    return once.select("page_id", F.regexp_replace(F.regexp_replace(body, r"(?U)(\s*\n){3,}", "\n\n"), r"(?U)^\s+|\s+$", "").alias("body"))


def main_sections(pages: DataFrame, template: DataFrame) -> DataFrame:
    """page_id, section_no, heading_path, content of the sections without the page's template lines, which are known there by their text without link and list markup; sections of nothing else drop out."""

    def bare(line):
        text = F.regexp_replace(line, r"\[([^\]]*)\]\([^)]*\)", "$1")
        text = F.regexp_replace(F.regexp_replace(text, r"(?U)^\s*(?:[-*+•]|[0-9]+[.)]|#{1,6})\s+", ""), r"(?U)\s+", " ")
        return F.lower(F.trim(text))

    gone = template.groupBy("page_id").agg(F.collect_list("line_no").alias("gone"))
    once = pages.where("page_id is not null").select("page_id", "raw_text", "sections").dropDuplicates(["page_id"]).join(gone, "page_id", "left")
    lines = F.transform(F.split("raw_text", "\n", -1), lambda line, i: F.named_struct(F.lit("i"), i, F.lit("line"), line))
    dropped = F.transform(F.filter(lines, lambda x: F.array_contains("gone", x["i"])), lambda x: bare(x["line"]))
    known = F.coalesce(dropped, F.array().cast("array<string>"))

    def cleaned(gone_here):
        def one(section):
            kept = F.filter(F.split(section["content"], "\n", -1), lambda x: ~F.array_contains(gone_here, bare(x)))
            return F.named_struct(F.lit("heading_path"), section["heading_path"], F.lit("content"), F.regexp_replace(F.array_join(kept, "\n"), r"(?U)^\s+|\s+$", ""))

        return F.transform("sections", one)

    # Bound as the one element of an array, the page's template texts are computed once and not for each line.
    sections = F.element_at(F.transform(F.array(known), cleaned), 1)
    return once.select("page_id", F.posexplode(sections).alias("section_no", "s")).select("page_id", "section_no", "s.heading_path", "s.content").where("content <> ''")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every non-blank line of a page that isn't part of its body."""
    found = template_lines(page_hosts(table(spark, sf_dir, "extracted_pages"), table(spark, sf_dir, "sites")))
    return found.select("page_id", F.col("line_no").cast("long").alias("line_no"))


def p4_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documentation body of every page."""
    pages = table(spark, sf_dir, "extracted_pages")
    return main_content(pages, template_lines(page_hosts(pages, table(spark, sf_dir, "sites"))))


def p4_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The body of every section."""
    pages = table(spark, sf_dir, "extracted_pages")
    return main_sections(pages, template_lines(page_hosts(pages, table(spark, sf_dir, "sites"))))


QUERIES = {"p4_found": p4_found, "p4_body": p4_body, "p4_sections": p4_sections}
ORACLES: dict[str, str] = {}

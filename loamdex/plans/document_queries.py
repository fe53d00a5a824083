"""Queries of the way from a page to its chunks and vectors, each with SQL: over whole tables where SQL can say what must come out, over small pages given here where it can't."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamdex.config import ChunkSettings
from loamdex.functions import html as H
from loamdex.functions import robots as R
from loamdex.functions import text as X
from loamdex.functions import urls as U
from loamdex.operators.chunking import chunk_documents, chunk_rows
from loamdex.operators.embed import HashingEmbedder, embed_column
from loamdex.operators.extract import extract_pages, page_links, page_sections
from loamdex.operators.index import as_vectors, index_pages
from loamdex.operators.python_columns import with_python_columns
from loamdex.plans.scratch import new_path
from loamdex.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# --- chunks

_SPACES = r"[\s\x0b\x{85}\p{Z}]"


def _tokens(t: str) -> str:
    return rf"cast((40 * len(regexp_extract_all({t}, '[^\s\x0b\x{{85}}\p{{Z}}]+')) + 3 * len(regexp_extract_all({t}, '[!-/:-@\[-`{{-~]'))) // 30 as bigint)"


def _strip(t: str) -> str:
    return rf"regexp_replace({t}, '^{_SPACES}+|{_SPACES}+$', '', 'g')"


def _code(t: str) -> str:
    return f"(contains({t}, '```') or regexp_matches({t}, '(?m)^ {{4}}'))"


def chunk_sql(source: str, s: ChunkSettings) -> str:
    """Common table expressions that end in ``final`` (doc, chunk_index, content, heading_path, token_count, has_code_blocks); ``source`` gives doc, sec, path, content and flag of every section."""
    head = f"list_reduce(list_concat([''], w[-{int(s.overlap_size * 0.75)}:]), lambda a, b: case when a = '' then b else a || ' ' || b end)"
    n = int(s.overlap_size * 0.75)
    return rf"""
with recursive src as (select doc, sec, coalesce(nullif(path, ''), 'Content') as path, content, flag, {_tokens('content')} as n from ({source}) where {_strip('content')} <> ''),
-- code: lines, packed to the maximum outside fences
cl as (select doc, sec, i, case when line like '%' || chr(13) then line[:-2] else line end as line from (select doc, sec, unnest(string_split(case when content like '%' || chr(10) then content[:-2] else content end, chr(10))) as line,
  generate_subscripts(string_split(case when content like '%' || chr(10) then content[:-2] else content end, chr(10)), 1) as i from src where n > {s.target_chunk_size} and flag)),
cm as materialized (select *, {_tokens('line')} as size, sum(case when regexp_matches(line, '^{_SPACES}*```') then 1 else 0 end) over (partition by doc, sec order by i) % 2 = 1 as fenced, {_strip('line')} = '' as blank from cl),
cf as (select doc, sec, i, size as total, blank, 1 as k from cm where i = 1
  union all select m.doc, m.sec, m.i, case when not m.fenced and f.total + m.size > {s.max_chunk_size} and not f.blank then m.size else f.total + m.size end,
   case when not m.fenced and f.total + m.size > {s.max_chunk_size} and not f.blank then m.blank else f.blank and m.blank end,
   f.k + case when not m.fenced and f.total + m.size > {s.max_chunk_size} and not f.blank then 1 else 0 end from cf f join cm m on m.doc = f.doc and m.sec = f.sec and m.i = f.i + 1),
cp as (select doc, sec, k, {_strip("string_agg(cm.line, chr(10) order by cm.i)")} as content from cf join cm using (doc, sec, i) group by doc, sec, k),
-- text: paragraphs, those above the maximum by sentences
pp as (select doc, sec, i, p, {_tokens('p')} as size from (select doc, sec, unnest(string_split(content, chr(10) || chr(10))) as p, generate_subscripts(string_split(content, chr(10) || chr(10)), 1) as i from src where n > {s.target_chunk_size} and not flag) where {_strip('p')} <> ''),
sp as (select doc, sec, i, row_number() over (partition by doc, sec, i order by j) as j, x from (select doc, sec, i, {_strip('x')} as x, j from (select doc, sec, i, unnest(string_split_regex(p, '[.!?]')) as x, generate_subscripts(string_split_regex(p, '[.!?]'), 1) as j from pp where size > {s.max_chunk_size})) where x <> ''),
sq as materialized (select doc, sec, i, j, t, {_tokens('t')} as size from (select doc, sec, i, j, case when j < max(j) over (partition by doc, sec, i) then x || '. ' else x end as t from sp)),
sf as (select doc, sec, i, j, size as total, 1 as k from sq where j = 1
  union all select q.doc, q.sec, q.i, q.j, case when f.total + q.size > {s.target_chunk_size} then q.size else f.total + q.size end, f.k + case when f.total + q.size > {s.target_chunk_size} then 1 else 0 end from sf f join sq q on q.doc = f.doc and q.sec = f.sec and q.i = f.i and q.j = f.j + 1),
ps as (select doc, sec, i, k, {_strip("string_agg(t, '' order by j)")} as p from sf join sq using (doc, sec, i, j) group by doc, sec, i, k),
pa as materialized (select doc, sec, p, size, row_number() over (partition by doc, sec order by i, k) as i from (select doc, sec, i, 0 as k, p, size from pp where size <= {s.max_chunk_size} union all select doc, sec, i, k, p, {_tokens('p')} from ps)),
pf as (select doc, sec, i, size as total, 1 as k from pa where i = 1
  union all select a.doc, a.sec, a.i, case when f.total + a.size > {s.target_chunk_size} then a.size else f.total + a.size end, f.k + case when f.total + a.size > {s.target_chunk_size} then 1 else 0 end from pf f join pa a on a.doc = f.doc and a.sec = f.sec and a.i = f.i + 1),
pc as (select doc, sec, k, {_strip("string_agg(p, chr(10) || chr(10) order by i)")} as content from pf join pa using (doc, sec, i) group by doc, sec, k),
-- all pieces of a page in order
pieces as (select doc, sec, 0 as k, path, content, flag, n as size from src where n <= {s.target_chunk_size}
  union all select c.doc, c.sec, c.k, path, c.content, flag and {_code('c.content')}, {_tokens('c.content')} from (select * from cp union all select * from pc) c join src on src.doc = c.doc and src.sec = c.sec where c.content <> ''),
pn as materialized (select *, row_number() over (partition by doc order by sec, k) as i from pieces),
-- small neighbours of one path are merged
mg as (select doc, i, 1 as g, size < {s.min_chunk_size} as held, size as total from pn where i = 1
  union all select p.doc, p.i, m.g + case when m.held and p.size < {s.min_chunk_size} and p.path = b.path and m.total + p.size <= {s.max_chunk_size} then 0 else 1 end,
   p.size < {s.min_chunk_size}, case when m.held and p.size < {s.min_chunk_size} and p.path = b.path and m.total + p.size <= {s.max_chunk_size} then m.total + p.size else p.size end
  from mg m join pn b on b.doc = m.doc and b.i = m.i join pn p on p.doc = m.doc and p.i = m.i + 1),
md as materialized (select doc, g as i, any_value(path) as path, string_agg(content, chr(10) || chr(10) order by i) as content, cast(sum(size) as bigint) as size, bool_or(flag) as flag from mg join pn using (doc, i) group by doc, g),
-- each begins with the last words of the one before
ov as (select doc, i, path, content, size, flag from md where i = 1
  union all select doc, i, path, case when h <> '' then h || chr(10) || chr(10) || content else content end, size + case when h <> '' then {_tokens('h')} else 0 end, flag from (
   select d.doc, d.i, d.path, d.content, d.size, d.flag, case when d.path = o.path and {n} > 0 and len(w) > {n} then {head} else '' end as h from (select *, regexp_extract_all(content, '[^\s\x0b\x{{85}}\p{{Z}}]+') as w from ov) o join md d on d.doc = o.doc and d.i = o.i + 1)),
final as (select doc, cast(i - 1 as bigint) as chunk_index, content, path as heading_path, size as token_count, flag as has_code_blocks from ov)
"""


_DOCUMENTS = f"select doc_id as doc, 0 as sec, coalesce(title, 'Content') as path, text as content, {_code('text')} as flag from documents where text is not null"
_PAGES = f"""select page_id as doc, cast(sec as bigint) as sec, s.heading_path as path, s.content as content, s.has_code_blocks as flag from (select page_id, unnest(sections) as s, generate_subscripts(sections, 1) as sec from (select distinct on (page_id) * from extracted_pages))
 union all select page_id, 0, title, raw_text, {_code('raw_text')} from (select distinct on (page_id) * from extracted_pages) where raw_text is not null and len(list_filter(coalesce(sections, []), lambda s: {_strip("coalesce(s.content, '')")} <> '')) = 0"""
_SMALL = ChunkSettings(target_chunk_size=200, max_chunk_size=400, min_chunk_size=60, overlap_size=40)


def _as_pages(documents: DataFrame) -> DataFrame:
    """Documents as pages of one section."""
    flag = X.has_code(F.col("text"))
    section = F.struct(F.coalesce("title", F.lit("Content")).alias("heading_path"), F.col("text").alias("content"), F.lit(None).cast("tinyint").alias("heading_level"), flag.alias("has_code_blocks"))
    return documents.where("text is not null").select("doc_id", "title", F.array(section).alias("sections"), F.col("text").alias("raw_text")).repartition("doc_id")


@query(chunk_sql(_DOCUMENTS, ChunkSettings()) + "select doc as doc_id, content, heading_path, chunk_index, token_count, has_code_blocks from final")
def chunk_rows_of_documents(spark, sf_dir):
    """Chunks of every document under the default settings."""
    return chunk_rows(chunk_documents(_as_pages(table(spark, sf_dir, "documents"))), "doc_id")


@query(chunk_sql(_DOCUMENTS, _SMALL) + "select doc as doc_id, content, heading_path, chunk_index, token_count, has_code_blocks from final")
def chunk_documents_small(spark, sf_dir):
    """Chunks of every document under small settings: code by lines, text by paragraphs and sentences, merged and overlapped."""
    return chunk_rows(chunk_documents(_as_pages(table(spark, sf_dir, "documents")), _SMALL), "doc_id")


_WORDS_ONLY = ChunkSettings(target_chunk_size=100, max_chunk_size=200, min_chunk_size=50, overlap_size=0, sentence_boundary_splitting=False)


@query(rf"""
with recursive w as materialized (select doc_id, i, x, greatest(1, {_tokens('x')}) as size from (select doc_id, unnest(l) as x, generate_subscripts(l, 1) as i from (select doc_id, regexp_extract_all(text, '[^\s\x0b\x{{85}}\p{{Z}}]+') as l from documents where text is not null))),
f as (select doc_id, i, size as total, 1 as k from w where i = 1
 union all select w.doc_id, w.i, case when f.total + w.size > 100 then w.size else f.total + w.size end, f.k + case when f.total + w.size > 100 then 1 else 0 end from f join w on w.doc_id = f.doc_id and w.i = f.i + 1)
select doc_id, k as piece, md5(string_agg(x, ' ' order by i)) as hash from f join w using (doc_id, i) group by doc_id, k""")
def word_pieces_of_documents(spark, sf_dir):
    """Every document cut between words only."""
    from loamdex.functions.chunks import split_words

    def compute(texts):
        for t in texts:
            yield (split_words(t, _WORDS_ONLY),)

    rows = with_python_columns(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text"), ["text"], [("pieces", T.ArrayType(T.StringType()))], compute)
    return rows.select("doc_id", F.posexplode("pieces").alias("n", "piece_text")).select("doc_id", (F.col("n") + 1).alias("piece"), F.md5("piece_text").alias("hash"))


@query(chunk_sql(_PAGES, ChunkSettings()) + "select sha256(concat_ws('|', site_id, url, chunk_index)) as id, page_id, chunk_index, token_count, heading_path, 64 as width from final join (select distinct on (page_id) * from extracted_pages) p on p.page_id = doc")
def page_chunks_embedded(spark, sf_dir):
    """Chunks of the cached pages with their vectors: the whole path from page to vector table."""
    pages = table(spark, sf_dir, "extracted_pages").dropDuplicates(["page_id"]).repartition("page_id")
    chunks = chunk_rows(chunk_documents(pages.select("page_id", "site_id", "url", "title", "sections", "raw_text")), "page_id", "site_id", "url", "title")
    vector_id = F.sha2(F.concat_ws("|", "site_id", "url", "chunk_index"), 256)
    return embed_column(chunks, HashingEmbedder(64)).select(vector_id.alias("id"), "page_id", "chunk_index", "token_count", "heading_path", F.size("vector").alias("width"))


@query(chunk_sql(_PAGES, _SMALL) + "select doc as page_id, chunk_index, md5(content) as hash, heading_path, token_count, has_code_blocks from final")
def page_chunks_small(spark, sf_dir):
    """Chunks of the cached pages under small settings, where paths decide what is merged and overlapped."""
    pages = table(spark, sf_dir, "extracted_pages").dropDuplicates(["page_id"]).repartition("page_id")
    return chunk_rows(chunk_documents(pages, _SMALL), "page_id").select("page_id", "chunk_index", F.md5("content").alias("hash"), "heading_path", "token_count", "has_code_blocks")


# --- embedding and indexing


class LetterEmbedder:
    """How often each of eight letters is in a text: vectors that SQL can give as well."""

    letters: ClassVar[str] = "aeionrst"
    width: ClassVar[int] = 8

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        return [[float(t.count(x)) for x in self.letters] for t in texts]

    def validate(self) -> None:
        pass


def _letters(t: str) -> str:
    return "[" + ", ".join(f"cast(length({t}) - length(replace({t}, '{x}', '')) as float)" for x in LetterEmbedder.letters) + "]"


@query(f"select doc_id, case when {_strip('text')} <> '' then {_letters('text')} end as vector from documents")
def documents_embedded(spark, sf_dir):
    """A vector beside each text, in its row; null and blank texts have none."""
    return embed_column(table(spark, sf_dir, "documents").select("doc_id", "text"), LetterEmbedder(), "text").select("doc_id", "vector")


_NOW = "2025-06-30 00:00:00"
_WHOLE = ChunkSettings(target_chunk_size=2048, max_chunk_size=4096, min_chunk_size=50, overlap_size=0)


@query(chunk_sql(_PAGES, _WHOLE) + f""", p as (select distinct on (page_id) page_id, site_id, url, coalesce(title, '') as title from extracted_pages)
select sha256(concat_ws('|', site_id, url, chunk_index)) as vector_id, site_id, url, title as page_title, heading_path, md5(content) as content_hash, token_count, chunk_index, {_letters('content')} as vector, timestamp '{_NOW}' as indexed_date, '2025-06-30T00:00:00Z' as created_at from final join p on p.page_id = doc""")
def pages_indexed(spark, sf_dir):
    """The vector table and the chunk table after indexing the cached pages twice, joined: the second run finds nothing left to do."""
    now = F.lit(_NOW).cast("timestamp_ntz")
    vectors, chunks = new_path(spark, "vectors"), new_path(spark, "chunks")
    pages = table(spark, sf_dir, "extracted_pages").dropDuplicates(["page_id"]).withColumn("title", F.coalesce("title", F.lit(""))).repartition("page_id")
    index_pages(pages, vectors, chunks, LetterEmbedder(), now, _WHOLE)
    known = spark.read.parquet(chunks).select("site_id", "url").distinct()
    again = pages.join(known, ["site_id", "url"], "left_anti")
    if not again.isEmpty():  # pages without any text
        index_pages(again, vectors, chunks, LetterEmbedder(), now, _WHOLE)
    v = spark.read.parquet(vectors).select(F.col("chunk_id").alias("vector_id"), "vector", "token_count", "content", "created_at")
    c = spark.read.parquet(chunks).join(v, "vector_id")
    return c.select("vector_id", "site_id", "url", "page_title", "heading_path", F.md5("content").alias("content_hash"), "token_count", "chunk_index", "vector", "indexed_date", "created_at").where("chunk_content = content")


@query("select vector_id as id, site_id, page_title, url as page_url, heading_path, chunk_content as content, chunk_index, vector_id as chunk_id, '2025-06-30T00:00:00Z' as created_at, 8 as width from (select distinct on (id) * from indexed_chunks where id is not null)")
def chunk_records_flattened(spark, sf_dir):
    """Chunks with vectors as rows of the vector table."""
    c = table(spark, sf_dir, "indexed_chunks").where("id is not null").dropDuplicates(["id"])
    rows = c.select("vector_id", "site_id", F.col("page_title").alias("title"), "url", "heading_path", F.col("chunk_content").alias("content"), F.lit(1).cast("long").alias("token_count"), "chunk_index", F.array(*(F.lit(0.0).cast("float") for _ in range(8))).alias("vector"))
    return as_vectors(rows, F.lit(_NOW).cast("timestamp_ntz")).select("id", "site_id", "page_title", "page_url", "heading_path", "content", "chunk_index", "chunk_id", "created_at", F.size("vector").alias("width"))


# --- pages over whole tables

_ESCAPES = ((r"\\", r"\\\\"), (r"\*", r"\\*"), (r"^-", r"\\-"), (r"^\+ ", r"\\+ "), (r"^(=+)", r"\\\1"), (r"^(#{1,6}) ", r"\\\1 "), ("`", r"\\`"), ("^~~~", r"\\~~~"), (r"\[", r"\\["), (r"\]", r"\\]"), ("^>", r"\\>"), ("_", r"\\_"), (r"^(\d+)\. ", r"\1\\. "))


def _escaped(t: str) -> str:
    for pattern, by in _ESCAPES:
        t = f"regexp_replace({t}, '{pattern}', '{by}', 'g')"
    return t


@query(f"select doc_id, md5({_escaped('text')}) as hash from documents where text is not null")
def markdown_escapes(spark, sf_dir):
    """Every text with what Markdown would read in it escaped."""

    def compute(texts):
        for t in texts:
            yield (H.escaped(t),)

    rows = with_python_columns(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text"), ["text"], [("escaped", T.StringType())], compute)
    return rows.select("doc_id", F.md5("escaped").alias("hash"))


def _sections_as_html(pages: DataFrame) -> DataFrame:
    """Cached pages as HTML: each section a heading and a paragraph a line, with furniture around them."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = lambda s: F.filter(F.split(s["content"], "\n", -1), lambda x: ~X.is_blank(x))
    body = F.array_join(F.transform("sections", lambda s: F.concat(F.lit("<h2>"), safe(s["heading_path"]), F.lit("</h2>\n"), F.array_join(F.transform(lines(s), lambda x: F.concat(F.lit("<p>"), safe(x), F.lit("</p>"))), "\n "))), "")
    page = F.concat(F.lit("<html><head><title>"), safe(F.coalesce("title", F.lit("none"))), F.lit("</title></head><body><nav>menu</nav><main><script>x()</script>"), body, F.lit("<div class='x ads'>buy</div></main><footer>end</footer></body></html>"))
    return pages.where("sections is not null").dropDuplicates(["page_id"]).repartition("page_id").select("page_id", "url", page.alias("html"))


def _flat(t: str) -> str:
    return rf"regexp_replace(regexp_replace({t}, '[ \t\r\n\f]+', ' ', 'g'), '^ | $', '', 'g')"


_HTML_LINES = f"""with s as (select page_id, title, unnest(sections) as s, generate_subscripts(sections, 1) as sec from (select distinct on (page_id) * from extracted_pages where sections is not null)),
l as (select page_id, sec, {_flat('s.heading_path')} as heading, list_transform(list_filter(string_split(coalesce(s.content, ''), chr(10)), lambda x: {_strip('x')} <> ''), lambda x: {_flat('x')}) as lines from s)"""


@query(_HTML_LINES + f"""select p.page_id, coalesce(nullif({_strip(_flat("coalesce(title, 'none')"))}, ''), 'Untitled Page') as title, md5({_strip("coalesce(string_agg(m, chr(10) || chr(10) order by sec), '')")}) as markdown_hash, cast(count(sec) filter (n > 0) as integer) as sections
 from (select distinct on (page_id) page_id, title from extracted_pages where sections is not null) p left join (select page_id, sec, len(lines) as n, array_to_string(list_concat(['## ' || {_escaped('heading')}], list_transform(lines, lambda x: {_escaped('x')})), chr(10) || chr(10)) as m from l) x using (page_id) group by p.page_id, p.title""")
def page_extraction(spark, sf_dir):
    """Title, Markdown and number of sections of every cached page, written as HTML and extracted again."""
    got = extract_pages(_sections_as_html(table(spark, sf_dir, "extracted_pages")))
    return got.select("page_id", X.trimmed(F.regexp_replace("title", "[ \t\r\n\f]+", " ")).alias("title"), F.md5("raw_text").alias("markdown_hash"), F.size("sections").alias("sections"))


@query(_HTML_LINES + f"""select page_id, cast(row_number() over (partition by page_id order by sec) - 1 as integer) as section_no, {_strip('heading')} as heading_path, md5({_strip("array_to_string(lines, chr(10))")}) as content_hash, 2 as heading_level, false as has_code_blocks from l where len(lines) > 0""")
def page_sections_extracted(spark, sf_dir):
    """Sections of every cached page, written as HTML and extracted again."""
    got = page_sections(extract_pages(_sections_as_html(table(spark, sf_dir, "extracted_pages"))), "page_id")
    return got.select("page_id", "section_no", X.trimmed(F.col("heading_path")).alias("heading_path"), F.md5("content").alias("content_hash"), F.col("heading_level").cast("int").alias("heading_level"), "has_code_blocks")


# --- small pages, given here with what must come out


def values(rows: Sequence[Sequence], columns: Sequence[str]) -> str:
    """SQL of literal rows."""

    def literal(v):
        if v is None:
            return "null"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, (int, float)):
            return str(v)
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(map(literal, v)) + "]"
        return "'" + v.replace("'", "''") + "'"

    return f"select * from (values {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) as t({', '.join(columns)})"


#: Name, body of an element, and its Markdown.
MARKDOWN = [
    ("paragraphs", "<p>one</p><p>two\n  three</p>", "one\n\ntwo three"),
    ("break", "a<br>b", "a  \nb"),
    ("rule", "<p>a</p><hr><p>b</p>", "a\n\n* * *\n\nb"),
    ("headings", "<h1>A</h1><h3>B <em>c</em></h3><h6>D</h6>", "# A\n\n### B _c_\n\n###### D"),
    ("empty heading", "<h2> </h2><p>x</p>", "x"),
    ("quote", "<blockquote><p>a</p><p>b</p></blockquote>", "> a\n> \n> b"),
    ("list", "<ul><li>one</li><li>two</li></ul>", "-   one\n-   two"),
    ("ordered", "<ol><li>one</li><li>two</li></ol>", "1.  one\n2.  two"),
    ("ordered from", '<ol start="42"><li>a</li><li>b</li></ol>', "42.  a\n43.  b"),
    ("nested", "<ul><li>a<ul><li>b</li><li>c</li></ul></li><li>d</li></ul>", "-   a\n    -   b\n    -   c\n-   d"),
    ("item of paragraphs", "<ul><li><p>a</p><p>b</p></li><li>c</li></ul>", "-   a\n    \n    b\n-   c"),
    ("strong", "<p>x <b>y</b> <strong> z </strong>.</p>", "x **y** **z** ."),
    ("emphasis", "<p><i>a</i><em></em>b</p>", "_a_b"),
    ("code", "<p>use <code>a_b</code></p>", "use `a_b`"),
    ("code with ticks", "<p><code>a`b</code> <code>`c</code></p>", "``a`b`` `` `c ``"),
    ("fence", '<pre><code class="language-rust">fn a() {\n  b_c\n}\n</code></pre>', "```rust\nfn a() {\n  b_c\n}\n```"),
    ("fence with fence", "<pre><code>```\nx\n```\n</code></pre>", "````\n```\nx\n```\n````"),
    ("pre of marks", "<pre>  *a*\n\n  <b>b</b></pre>", "```\n  *a*\n\n  b\n```"),
    ("link", '<a href="/x(1)" title="t &quot;q&quot;">l</a>', '[l](/x\\(1\\) "t \\"q\\"")'),
    ("link without address", "<a>l</a>", "l"),
    ("image", '<img src="a.png" alt="b" title="c">', '![b](a.png "c")'),
    ("image without source", '<p>x<img alt="b"></p>', "x"),
    ("escapes", "<p>a*b _c_ [d] \\e `f`</p><p>- g</p><p>1. h</p><p># i</p><p>+ j</p><p>&gt; k</p><p>== l</p>", "a\\*b \\_c\\_ \\[d\\] \\\\e \\`f\\`\n\n\\- g\n\n1\\. h\n\n\\# i\n\n\\+ j\n\n\\> k\n\n\\== l"),
    ("suppressed", '<script>a()</script><style>b</style><nav>c</nav><aside>d</aside><button>e</button><div class="sidebar x">f</div><p>kept</p>', "kept"),
    ("space", "<p>  a \n\t b  </p>\n\n<div> c <span> d</span></div>", "a b\n\nc d"),
    ("entities", "<p>&lt;T&gt; &amp; &quot;x&quot;</p>", '<T> & "x"'),
    ("open paragraphs", "<p>a<p>b<ul><li>c<li>d</ul>", "a\n\nb\n\n-   c\n-   d"),
]


@query(values([(n, m) for n, _, m in MARKDOWN], ["name", "markdown"]))
def markdown_cases(spark, sf_dir):
    """Markdown of small pages, one rule each."""
    pages = spark.createDataFrame([(n, f"<html><body><main>{h}</main></body></html>") for n, h, _ in MARKDOWN], "name string, html string").withColumn("url", F.lit("https://e.example/d/"))
    return extract_pages(pages).select("name", F.col("raw_text").alias("markdown"))


#: Page, and of each of its sections path, content, level and whether it has code.
SECTIONS = [
    ("<h1>A</h1><p>one</p><h2>B</h2><p>two</p><h3>C</h3>three<h2>D</h2>four", [("A", "one", 1, False), ("A > B", "two", 2, False), ("A > B > C", "three", 3, False), ("A > D", "four", 2, False)]),
    ("<p>before</p><h2>A</h2><p>x</p><h1>B</h1><p>y</p>", [("Content", "before", None, False), ("A", "x", 2, False), ("B", "y", 1, False)]),
    ("<h1>A</h1><h2>B</h2><p>only here</p><h2>C</h2>", [("A > B", "only here", 2, False)]),
    ("<h1>A</h1><pre><code>x = 1\n</code></pre><h2>B</h2><p>text</p>", [("A", "```\nx = 1\n```", 1, True), ("A > B", "text", 2, False)]),
    ("<h1>A</h1><p>call <code>f()</code></p><ul><li>a</li><li>b</li></ul>", [("A", "call `f()`\n• a\n• b", 1, True)]),
    ("<h1> A <em>b</em>\n c </h1>t", [("A b c", "t", 1, False)]),
    ("<p>plain</p>", [("Content", "plain", None, False)]),
    ("<p>Vec&lt;T&gt; is <b>generic</b></p>", [("Content", "Vec<T> is generic", None, False)]),
]


@query(values([(k, n, *s) for k, (_, found) in enumerate(SECTIONS) for n, s in enumerate(found)], ["page", "section_no", "heading_path", "content", "heading_level", "has_code_blocks"]))
def section_cases(spark, sf_dir):
    """Sections of small pages: the stack of headings, code and lists."""
    pages = spark.createDataFrame([(k, f"<html><body><main>{h}</main></body></html>") for k, (h, _) in enumerate(SECTIONS)], "page int, html string").withColumn("url", F.lit("https://e.example/d/"))
    return page_sections(extract_pages(pages), "page").select("page", "section_no", "heading_path", "content", F.col("heading_level").cast("int").alias("heading_level"), "has_code_blocks")


#: Page, its title, the text of its main content and why it seems to be built by scripts.
PAGES = [
    ("<html><head><title> T </title></head><body><h1>H</h1></body></html>", "T", "# H", None),
    ("<html><body><h2>first</h2><h1>H</h1></body></html>", "H", "## first\n\n# H", None),
    ("<html><body><h3>only</h3></body></html>", "only", "### only", None),
    ("<html><body><p>x</p></body></html>", "Untitled Page", "x", None),
    ("<html><body><p>out</p><article><p>in</p></article></body></html>", "Untitled Page", "in", None),
    ('<html><body><p>out</p><div id="content">in</div></body></html>', "Untitled Page", "in", None),
    ('<html><body><p>out</p><div class="a main-content">in</div></body></html>', "Untitled Page", "in", None),
    ('<html><body><div data-reactroot="">x</div></body></html>', "Untitled Page", "x", "react"),
    ("<html><body><div ng-app>x</div></body></html>", "Untitled Page", "x", "angular"),
    ('<html><body><script src="/js/bundle.1.js"></script>x</body></html>', "Untitled Page", "x", "bundle"),
    ("<html><body><script></script><script></script><script></script><script></script>x</body></html>", "Untitled Page", "x", "little text"),
    (None, None, None, None),
]


@query(values([(k, *p[1:]) for k, p in enumerate(PAGES)], ["page", "title", "markdown", "dynamic"]))
def page_cases(spark, sf_dir):
    """Titles, main content and signs of scripts of small pages; no page gives nulls."""
    pages = spark.createDataFrame([(k, p[0]) for k, p in enumerate(PAGES)], "page int, html string").withColumn("url", F.lit("https://e.example/d/"))
    return extract_pages(pages).select("page", "title", F.col("raw_text").alias("markdown"), "dynamic")


@query(values([(k, f"<{m[2]}>" if k % 2 else m[2]) for k, m in enumerate([("", "", "_a_"), ("", "", "_a_")])], ["page", "markdown"]))
def markdown_rule_hook(spark, sf_dir):
    """A rule of the caller sees what the built-in rule gave, and replaces it."""
    pages = spark.createDataFrame([(0, "<main><em>a</em></main>", "u"), (1, "<main><i>a</i></main>", "u")], "page int, html string, url string")
    return extract_pages(pages, rules={"i": lambda out, node: f"<{out}>"}).select("page", F.col("raw_text").alias("markdown"))


#: Address of a page, and each reference on it with the link it gives (null for none).
LINKS = [
    ("https://e.example/a/b/c", [("d", "https://e.example/a/b/d"), ("../x", "https://e.example/a/x"), ("../../../y", "https://e.example/y"), ("./", "https://e.example/a/b/"), ("/", "https://e.example/"), ("//o.example/p", "https://o.example/p"), ("?q=1", "https://e.example/a/b/c?q=1"), ("http://E.Example:80/Z", "http://e.example/Z")]),
    ("https://e.example/a/", [("index.html", "https://e.example/a/"), ("i/index.php?x=1", "https://e.example/a/i/?x=1"), ("j/index.htm#f", "https://e.example/a/j/#f"), ("#top", None), ("mailto:a@e.example", None), ("javascript:void(0)", None), ("https://e.example:8443/k", "https://e.example:8443/k")]),
]


@query(values([(k, to) for k, (_, refs) in enumerate(LINKS) for _, to in refs if to], ["page", "link"]))
def link_cases(spark, sf_dir):
    """Links of small pages: references resolved, index files and default ports dropped."""
    rows = [(k, url, "<main>" + "".join(f'<a href="{r}">x</a>' for r, _ in refs) + "</main>") for k, (url, refs) in enumerate(LINKS)]
    pages = spark.createDataFrame(rows, "page int, url string, html string")
    return extract_pages(pages).select("page", F.explode("links").alias("link"))


#: robots.txt of a host, agent, path and whether it is open.
ROBOTS = [
    ("User-agent: *\nDisallow: /private/\nAllow: /private/open", "anybot", [("/private/a", False), ("/private/open/b", True), ("/public", True)]),
    ("User-agent: *\nDisallow: /\n\nUser-agent: AnyBot\nDisallow: /tmp", "anybot", [("/tmp/x", False), ("/other", False)]),
    ("User-agent: anybot\nAllow: /\n\nUser-agent: *\nDisallow: /", "anybot", [("/x", True)]),
    ("User-agent: *\nDisallow:", "anybot", [("/x", False)]),
    ("# only a comment\n\nSitemap: https://e.example/s.xml", "anybot", [("/x", True)]),
    ("User-agent: *\r\nDisallow: /docs/* # all of them\r\n", "anybot", [("/docs/a", False), ("/docs", True)]),
    ("Disallow: /before", "anybot", [("/before/x", True)]),
    ("User-agent: one\nUser-agent: two\nDisallow: /b", "one", [("/b", True)]),
    ("User-agent: one\nUser-agent: two\nDisallow: /b", "two", [("/b", False)]),
    (None, "anybot", [("/x", True)]),
]


@query(values([(k, path, open_) for k, (_, _, paths) in enumerate(ROBOTS) for path, open_ in paths], ["host", "path", "allowed"]))
def robots_cases(spark, sf_dir):
    """Rules of several hosts and agents: groups, comments, an empty Disallow, and hosts without rules."""
    out = None
    for agent in sorted({a for _, a, _ in ROBOTS}):
        rows = [(k, path, f"https://h{k}.example{path}", f"h{k}.example", body) for k, (body, a, paths) in enumerate(ROBOTS) if a == agent for path, _ in paths]
        df = spark.createDataFrame(rows, "host int, path string, url string, name string, body string")
        sets = df.where("body is not null").select(F.col("name").alias("host"), "body").distinct()
        got = R.open_urls(df.select("host", "path", "url"), sets, agent).select("host", "path", "allowed")
        out = got if out is None else out.unionByName(got)
    return out


# --- functions of text and addresses


@query(r"select id, case when b like '%/' or regexp_matches(b, '^[a-zA-Z]+://[^/]+/(.*/)?[^/]*\.[^/]*$') then b else b || '/' end as address from (select id, regexp_replace(url, '/index\.[a-zA-Z0-9]+$', '/') as b from (select distinct id, url from crawl_queue where id is not null))")
def addresses_with_slash(spark, sf_dir):
    """Every queued address as the index address of a site."""
    return table(spark, sf_dir, "crawl_queue").where("id is not null").select("id", "url").distinct().select("id", U.with_slash(F.col("url")).alias("address"))


@query(r"select doc_id, url is not null and regexp_matches(url, '^(?i:https?)://[^/?#]+') as ok from documents")
def web_addresses(spark, sf_dir):
    """Whether each document's address is one of the web."""
    return table(spark, sf_dir, "documents").select("doc_id", U.is_web_url(F.col("url")).alias("ok"))


@query(r"select h as href, count(*) as links, starts_with(h, 'mailto:') or starts_with(h, 'javascript:') or starts_with(h, '#') or starts_with(h, '\#') as skipped from (select unnest(regexp_extract_all(raw_text, '\]\(([^)\s]+)\)', 1)) as h from extracted_pages) group by all")
def skipped_links(spark, sf_dir):
    """Every reference in the Markdown of the cached pages and whether it leads nowhere else."""
    refs = table(spark, sf_dir, "extracted_pages").select(F.explode(F.regexp_extract_all("raw_text", F.lit(r"\]\(([^)\s]+)\)"), 1)).alias("href"))
    return refs.groupBy("href").agg(F.count("*").alias("links")).withColumn("skipped", U.skipped_href(F.col("href")))


@query(rf"""select site_id, {_strip('site_id')} <> '' and not (regexp_matches({_strip('site_id')}, '^-?[0-9]+$') and coalesce(try_cast({_strip('site_id')} as hugeint), 1) <= 0) as identifier, {_strip('site_id')} <> '' and strlen(site_id) <= 100 and not regexp_matches(site_id, '[\n\r\t]') as name, {_strip('site_id')} <> '' and strlen(site_id) <= 40 and not regexp_matches(site_id, '[\n\r\t]') as version
 from (select distinct site_id from embedding_records where site_id is not null)""")
def identifier_checks(spark, sf_dir):
    """Which of the site identifiers met in the records would pass as identifier, name and version."""
    c = F.col("site_id")
    return table(spark, sf_dir, "embedding_records").where("site_id is not null").select("site_id").distinct().select("site_id", X.valid_identifier(c).alias("identifier"), X.valid_name(c).alias("name"), X.valid_version(c).alias("version"))


@query(r"select doc_id, regexp_extract(a, 'language-(\S+)', 1) as language, regexp_replace(coalesce(text, ''), '(\n+[ \t\n\x0b\f\r]*)+', chr(10), 'g') = regexp_replace(regexp_replace(coalesce(text, ''), '(\n+[ \t\n\x0b\f\r]*)+', chr(10), 'g'), '(\n+[ \t\n\x0b\f\r]*)+', chr(10), 'g') as clean from (select *, 'hljs language-' || coalesce(lang, '') || ' x' as a from documents)")
def attribute_values(spark, sf_dir):
    """The language that a class attribute names, and whether a cleaned attribute stays as it is."""
    d = table(spark, sf_dir, "documents").withColumn("a", F.concat(F.lit("hljs language-"), F.coalesce("lang", F.lit("")), F.lit(" x")))
    once = X.clean_attribute(F.coalesce("text", F.lit("")))
    return d.select("doc_id", X.code_language(F.col("a")).alias("language"), (once == X.clean_attribute(once)).alias("clean"))


@query(r"select doc_id, md5(regexp_replace(text, '(\n+[ \t\n\x0b\f\r]*)+', chr(10), 'g')) as hash from documents where text is not null")
def attributes_cleaned(spark, sf_dir):
    """Every text as the value of an attribute."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5(X.clean_attribute(F.col("text"))).alias("hash"))


@query("select page_id, cast(sec - 1 as integer) as section_no, case when path = '' then 'Content' else array_to_string(string_split(path, ' > '), ' > ') end as heading_path from (select page_id, coalesce(s.heading_path, '') as path, sec from (select page_id, unnest(sections) as s, generate_subscripts(sections, 1) as sec from (select distinct on (page_id) * from extracted_pages)))")
def heading_paths(spark, sf_dir):
    """The path of every section from the stack of its headings."""
    pages = table(spark, sf_dir, "extracted_pages").dropDuplicates(["page_id"])
    stack = F.filter(F.split(F.coalesce("s.heading_path", F.lit("")), " > ", -1), lambda x: x != "")
    return pages.select("page_id", F.posexplode("sections").alias("section_no", "s")).select("page_id", "section_no", X.heading_path(stack).alias("heading_path"))


@query("""select id, '{' || chr(10) || '  "id" : ' || id || ',' || chr(10) || '  "name" : "' || replace(replace(name, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '",' || chr(10) || '  "version" : "' || version || '"' || chr(10) || '}' as json from sites""")
def sites_as_json(spark, sf_dir):
    """Each site as the JSON text of a tool's answer."""
    return table(spark, sf_dir, "sites").select("id", X.pretty_json(F.struct("id", "name", "version")).alias("json"))


@query(values([("chunks", 0, "one two three"), ("sections", 0, "A"), ("sections", 1, "A > B"), ("url", 0, "https://e.example/a/c")], ["name", "n", "value"]))
def sql_functions(spark, sf_dir):
    """The document functions from SQL, the table functions in lateral joins."""
    from loamdex.functions.sql import register

    register(spark)
    return spark.sql(
        "select 'chunks' as name, cast(c.chunk_index as int) as n, c.content as value from values ('one two three'), (null) as t(x), lateral chunks_of(t.x, 100, 200) c"
        " union all select 'sections', s.section_no, s.heading_path from lateral sections_of('<h1>A</h1>x<h2>B</h2>y') s"
        " union all select 'url', 0, resolve_url('https://e.example/a/b', 'c')"
    )

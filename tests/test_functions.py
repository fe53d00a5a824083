import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamdex.config import ChunkSettings, ConfigError, EmbedSettings, Settings
from loamdex.functions import chunks as ch
from loamdex.functions import html as H
from loamdex.functions import robots as R
from loamdex.functions import text as X
from loamdex.functions import urls as U


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}")
    return [r.y for r in df.select("k", expr(F.col("x")).alias("y")).orderBy("k").collect()]


TEXTS = ["Hello world", "This is a test.", "", "Two.", "a　b c", "x = f(1);\n    y", "```\ncode\n```", "  ", "one two three four five six"]


def test_token_estimate_is_the_same_in_both_forms(spark):
    assert column(spark, TEXTS, X.estimated_tokens) == [ch.tokens(t) for t in TEXTS]
    assert [ch.tokens(t) for t in TEXTS[:3]] == [2, 5, 0]
    assert column(spark, TEXTS, X.has_code) == [ch.code_in(t) for t in TEXTS]
    assert column(spark, TEXTS, lambda c: X.overlap_tail(c, 4)) == [ch.overlap_of(t, 4) for t in TEXTS]


def test_paths(spark):
    cases = {"/docs/": "/docs/", "/docs": "/docs/", "/docs/index.html": "/docs/", "/a/b.c/d": "/a/b.c/d/", "/": "/", "": "/"}
    assert column(spark, cases, U.directory) == list(cases.values())
    assert column(spark, ["/a/index.html", "/index.htm", "/a/indexes.html", "/a"], U.without_index) == ["/a/", "/", "/a/indexes.html", "/a"]
    assert column(spark, ["https://h/docs", "https://h/docs/", "https://h/a/index.html", "https://h/a.b", "https://h"], U.with_slash) == ["https://h/docs/", "https://h/docs/", "https://h/a/", "https://h/a.b", "https://h/"]
    assert column(spark, ["https://h.x/a/b/", "https://h.x", "https://h.x/docs"], U.default_site_name) == ["h.x a b ", "h.x", "h.x docs"]
    assert column(spark, ["mailto:a", "#x", "\\#x", "/a", "javascript:0", "Mailto:b"], U.skipped_href) == [True, True, True, False, True, False]
    assert column(spark, ["http://a/b", "ftp://a", "https:///x", "no url", None], U.is_web_url) == [True, False, False, False, False]


def test_scope(spark):
    base = "https://example.com/docs/index.html"
    urls = ["https://example.com/docs/a", "https://example.com:8080/docs/b", "https://example.com/doc", "http://example.com/docs/a", "https://other.com/docs/a", "bad"]
    assert column(spark, urls, lambda c: U.in_scope(c, F.lit(base))) == [True, True, False, False, False, False]


def test_resolve():
    cases = [("https://H.com/a/b", "../c", "https://h.com/c"), ("https://h.com/a/", "x?q#f", "https://h.com/a/x?q#f"), ("https://h.com:443", "", "https://h.com/"), ("http://h.com/a", "//K.com", "http://k.com/"), ("http://h.com", "c\\d", "http://h.com/c/d"), ("x", "y", None), (None, "y", None), ("http://h.com", "http://[bad", None)]
    assert [U.resolve(b, h) for b, h, _ in cases] == [w for *_, w in cases]


def test_resolve_column(spark):
    df = spark.createDataFrame([("https://h.com/a/", "b"), (None, "b")], "b string, h string")
    assert [r.y for r in df.select(U.resolved()("b", "h").alias("y")).collect()] == ["https://h.com/a/b", None]


ROBOTS = "# all\nUser-agent: *\nDisallow: /private/\nAllow: /private/open\nDisallow: /tmp*\n\nuser-AGENT: OtherBot\nUser-agent: MyBot\nDisallow: /mine # own\nAllow: /private/\n"


@pytest.mark.parametrize(
    "body,agent,path,want",
    [
        (ROBOTS, "x", "/private/a", False), (ROBOTS, "x", "/private/open/b", True), (ROBOTS, "x", "/tmpfile", False), (ROBOTS, "x", "/a", True), (ROBOTS, "mybot", "/mine/x", False), (ROBOTS, "MyBot", "/private/a", True),
        (ROBOTS, "otherbot", "/mine", True), ("User-agent: *\nDisallow:", "x", "/a", False), ("", "x", "/a", True), (None, "x", "/a", True), ("Disallow: /a", "x", "/a", True), ("User-agent: *\r\nDisallow: /a\r\n", "x", "/a", False),
    ],
)
def test_robots(spark, body, agent, path, want):
    df = spark.createDataFrame([(body, path)], "body string, path string").withColumn("r", F.when(F.col("body").isNotNull(), R.rules(F.col("body"))))
    assert df.select(R.allowed(F.col("path"), F.col("r"), agent).alias("y")).first().y is want


def test_small_functions(spark):
    assert column(spark, ["Connection reset", "HTTP error 503", "HTTP error 404", "http error 429", None, "timeout"], X.retryable) == [True, True, False, True, False, True]
    assert column(spark, ["5", "0", "-1", " ", "name", None], X.valid_identifier) == [True, False, False, False, True, False]
    assert column(spark, ["a" * 100, "a" * 101, "é" * 51, "a\nb", ""], X.valid_name) == [True, False, False, False, False]
    assert column(spark, [29, 57, 58, 0], lambda c: X.percent(c, F.lit(100)), "int") == [28, 56, 57, 0]  # the quotient of doubles is a little less
    assert column(spark, [["A", "B"], []], X.heading_path, "array<string>") == ["A > B", "Content"]
    assert column(spark, ["x language-rust y", ""], X.code_language) == ["rust", ""]


def test_settings(tmp_path):
    assert Settings.load(tmp_path) == Settings(folder=tmp_path)
    s = Settings(EmbedSettings(model='m "x"', port=1), ChunkSettings(target_chunk_size=100, max_chunk_size=200, min_chunk_size=50), tmp_path)
    s.save()
    assert Settings.load(tmp_path) == s
    (tmp_path / "config.toml").write_text("[embedding]\nmodel = 'm'\n")
    assert Settings.load(tmp_path).chunking == ChunkSettings()
    for bad in (dict(protocol="HTTP"), dict(port=0), dict(model=" "), dict(batch_size=0), dict(batch_size=1001), dict(embedding_dimension=63), dict(embedding_dimension=4097), dict(host="a b")):
        with pytest.raises(ConfigError):
            Settings(EmbedSettings(**bad)).check()
    for bad in (dict(target_chunk_size=99), dict(max_chunk_size=640), dict(min_chunk_size=640), dict(overlap_size=513), dict(min_chunk_size=49)):
        with pytest.raises(ConfigError):
            Settings(chunking=ChunkSettings(**bad)).check()


SMALL = ChunkSettings(target_chunk_size=50, max_chunk_size=100, min_chunk_size=10, overlap_size=8)


def section(content, path="A", code=False):
    return {"heading_path": path, "content": content, "has_code_blocks": code}


def test_chunks():
    assert ch.chunk_page("t", [], "") == [] and ch.chunk_page("t", None, "  ") == []
    one = ch.chunk_page("t", [section(" short text ")], "raw")
    assert [(c["content"], c["chunk_index"]) for c in one] == [(" short text ", 0)]
    assert ch.chunk_page("T", [], "raw text")[0]["heading_path"] == "T"
    long = ch.chunk_page("t", [section("This is a sentence of words. " * 40)], None, SMALL)
    assert len(long) > 1 and [c["chunk_index"] for c in long] == list(range(len(long)))
    for a, b in zip(long, long[1:]):
        assert b["content"].startswith(" ".join(a["content"].split()[-6:]))
    fence = "intro\n```\n" + "let x = 1;\n" * 60 + "```\nend"
    parts = ch.split_code(fence, SMALL)
    assert sum("let x" in p for p in parts) == 1
    paragraphs = "\n\n".join(f"paragraph {k} " + "word " * 20 for k in range(6))
    assert all(ch.tokens(p) <= 50 for p in ch.split_paragraphs(paragraphs, SMALL))


def test_small_chunks_merge_within_a_path_only():
    pages = [section("a b c"), section("d e f"), section("g h i", "B")]
    assert [(c["content"], c["heading_path"]) for c in ch.chunk_page("t", pages, None, SMALL)] == [("a b c\n\nd e f", "A"), ("g h i", "B")]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["word", "a.b", "End.", "```", "\n", "\n\n", "    x", "why?", "　", "!"]), max_size=150).map(" ".join), st.booleans())
def test_chunks_lose_no_words(text, code):
    plain = ChunkSettings(50, 100, 10, 0)
    got = ch.chunk_page("t", [section(text, code=code)], text, plain)
    strip = lambda t: [w for w in "".join(c if c not in ".?!" else " " for c in t).split() if w]
    assert strip(" ".join(c["content"] for c in got)) == strip(text)


PAGE = """<html><head><title> My <b>no</b> Page </title><script>var t="</p>";</script></head><body><nav><a href="/n">nav</a></nav>
<article><h1>Top <button>copy</button></h1><p>first <b>bold <i>both</i></b>, <code>x`y</code>.<p>second &lt;T&gt; a*b
<ul><li>one<li>two<ul><li>inner</ul></ul><div class="ads">buy</div><h2>Code</h2><pre><code class="language-rust">fn main() {
    x
}
</code></pre><h3>Deep</h3>text<h2>Last</h2><p>end<br>line</article><footer>foot</footer></body></html>"""


def test_html():
    got = H.extract(PAGE, "https://e.com/d/p")
    assert got["title"].split() == ["My", "Page"]
    assert [s["heading_path"] for s in got["sections"]] == ["Top", "Top > Code", "Top > Code > Deep", "Top > Last"]
    assert [s["has_code_blocks"] for s in got["sections"]] == [True, True, False, False]
    assert "<T>" in got["sections"][0]["content"] and "• inner" in got["sections"][0]["content"] and "buy" not in got["raw_text"] and "foot" not in got["raw_text"]
    assert "```rust\nfn main() {\n    x\n}\n```" in got["raw_text"] and "**bold _both_**" in got["raw_text"] and "``x`y``" in got["raw_text"] and "a\\*b" in got["raw_text"]
    assert got["links"] == ["https://e.com/n"]
    assert H.extract(None) is None and H.extract("")["title"] == "Untitled Page" and H.extract("")["sections"] == []


def test_broken_html():
    got = H.extract("<title>T</title><h1>Head<p>open <b>bold<p>still <span>more<div>end")
    assert got["title"] == "T" and "more" in got["raw_text"] and got["raw_text"].count("**") == 6
    assert H.extract("<h2>Second</h2>x")["title"] == "Second"
    assert H.extract("<p>only text</p>")["sections"][0]["heading_path"] == "Content"


def test_links():
    html = '<a href="a">1</a><a href="/x/index.html#f">2</a><a href="mailto:q">3</a><a href="#t">4</a><a href="javascript:x">5</a><a>6</a><a href="https://o.com">7'
    assert H.extract(html, "https://e.com/d/p")["links"] == ["https://e.com/d/a", "https://e.com/x/#f", "https://o.com/"]


def test_long_and_deep_html():
    deep = "<div>" * 400 + "text" + "</div>" * 400
    assert H.extract(deep)["raw_text"] == "text"
    assert len(H.extract("<p>" + "word " * 200_000)["raw_text"]) > 900_000


def test_rules_see_the_built_in_output():
    assert H.extract("<p>a <em>b</em></p>", rules={"em": lambda out, n: f"<{out}>"})["raw_text"] == "a <_b_>"


def test_sql_functions(spark):
    from loamdex.functions.sql import register

    register(spark)
    text = "Some words of a sentence. " * 200
    rows = spark.sql(f"select c.* from values ('{text}'), (null) as t(x), lateral chunks_of(t.x, 100, 200) c order by chunk_index").collect()
    assert [r.chunk_index for r in rows] == list(range(len(rows))) and len(rows) > 5
    got = spark.sql("select s.heading_path, resolve_url('http://h.com/a/', 'b') as u from lateral sections_of('<h1>A</h1>x<h2>B</h2>y') s").collect()
    assert [r.heading_path for r in got] == ["A", "A > B"] and got[0].u == "http://h.com/a/b"

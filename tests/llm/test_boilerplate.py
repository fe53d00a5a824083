import random
import time

from loamdex.llm import boilerplate as bp

WORDS = "shard lease probe kernel buffer router ledger anchor module socket vector thread".split()


def page(k, rng):
    """Lines with whether they belong to the body."""
    sentence = lambda: f"The {rng.choice(WORDS)} {rng.choice(WORDS)} {k} {rng.choice(WORDS)}s every {rng.choice(WORDS)} {rng.choice(WORDS)} of the {rng.choice(WORDS)}{rng.random()}."
    title = f"How to {rng.choice(WORDS)} a {rng.choice(WORDS)} {chr(97 + k % 26)}{chr(97 + k // 26)} {rng.choice(WORDS)}"
    lines = [
        ("Skip to the content of this page", 0), ("[Home](/home) [Blog](/blog)", 0), (f"Docs › {rng.choice(WORDS)} › {title}", 0), ("", 1),
        (f"# {title}", 1), ("", 1), (f"Written by the storage guild · {k} min read", 0), ("", 1),
        (sentence(), 1), ("Note: the examples on this page assume a local installation.", 1), ("", 1),
        (f"## The {rng.choice(WORDS)} option", 1), ("```", 1), ("Skip to the content of this page", 1), ("```", 1),
        ("| Name | Use |", 1), ("| --- | --- |", 1), (f"| a{k} | {rng.choice(WORDS)} |", 1), ("", 1),
        ("Edit this page on the forge" if k % 2 else "  EDIT this  page on the forge ", 0), (sentence(), 1), ("", 1),
        ("## On this page", 0), (f"-   [{rng.choice(WORDS)} {k}](#{rng.choice(WORDS)})", 0), (f"-   [{rng.choice(WORDS)}](#x{k})", 0), ("", 1),
        (f"Previous: {rng.choice(WORDS)} {rng.choice(WORDS)}    Next: {rng.choice(WORDS)} of {rng.choice(WORDS)}", 0), (f"Copyright {2000 + k} The Authors", 0),
    ]
    return title, lines


def test_pages(spark):
    rng = random.Random(4)
    rows, truth = [], set()
    for k in range(60):
        title, lines = page(k, rng)
        rows.append((f"h{k % 2}", k, title if k % 7 else None, "\n".join(x for x, _ in lines), 1))
        truth |= {(k, n) for n, (x, body) in enumerate(lines) if not body and x.strip()}
    rows += [rows[0], ("h1", 100, None, "", 1), ("h1", 101, None, None, 1), ("h9", 102, "T", "Skip to the content of this page", 1), ("h1", 103, "t", "```\n" + "word " * 100_000, 1)]
    df = spark.createDataFrame(rows, "host string, page_id long, title string, raw_text string, key int")
    df = df.where("raw_text is not null")
    got = [(r.page_id, r.line_no) for r in bp.template_lines(df).collect()]
    assert len(got) == len(set(got))
    assert not set(got) - truth, sorted(set(got) - truth)[:5]
    assert len(truth & set(got)) >= 0.97 * len(truth)
    bodies = {r.page_id: r.body for r in bp.main_content(df, bp.template_lines(df)).collect()}
    assert "On this page" not in bodies[5] and "| Name | Use |" in bodies[5] and bodies[5].startswith("# How to") and bodies[100] == ""
    assert bp.template_lines(df.limit(0)).count() == 0


def test_query(spark, sf):
    found = bp.p4_found(spark, sf)
    assert found.count() > 0 and set(found.columns) == {"page_id", "line_no"}
    assert bp.p4_body(spark, sf).count() > 0
    assert bp.p4_sections(spark, sf).count() > 0


def test_sections(spark):
    text = "[Home](/home)\n\n# T\n\nbody [x](/y) text\n\n-   [Blog – a](/blog)\n-   kept item"
    rows = [(1, text, [("Content", "Home"), ("T", "body x text\n•  Blog – a\n• kept item")]), (2, None, [("T", "as it is")]), (3, text, None)]
    pages = spark.createDataFrame(rows, "page_id long, raw_text string, sections array<struct<heading_path string, content string>>")
    template = spark.createDataFrame([(1, 0), (1, 6)], "page_id long, line_no int")
    got = [(r.page_id, r.section_no, r.content) for r in bp.main_sections(pages, template).orderBy("page_id").collect()]
    assert got == [(1, 1, "body x text\n• kept item"), (2, 0, "as it is")]


def test_unique_content_stays(spark):
    """Lines that no other page of the host has, whatever their place and form, are body."""
    rows = []
    for k in range(40):
        w = [f"{a}{'abcdefghij'[k // 10]}{'abcdefghij'[k % 10]}" for a in WORDS]
        title = f"The {w[0]} of {w[1]}"
        lines = [f"A {w[2]} before all else, said {w[3]}", f"# {title}", f"{w[4]} {w[5]}", "", f"A {w[6]} is a {w[7]}.", f"- [{w[8]} {w[9]}](/{w[10]})", "", f"{w[1]} > {w[2]} / {w[3]}", f"## {w[11]}", f"- [{w[0]}](/{w[3]})"]
        rows.append(("h", k, title, "\n".join(lines)))
    assert bp.template_lines(spark.createDataFrame(rows, "host string, page_id long, title string, raw_text string")).count() == 0


def test_long_lines():
    """Lines of a million characters that almost are links, quotations or labels take linear time."""
    began = time.time()
    for part in ("[", "[x](", "[x](y ", "“x ", "a: ", "- [", "x › ", "# ", "`", "← "):
        top, filled, _ = bp.elements("# T\n" + part * (1_000_000 // len(part)) + "\n- [a](" + part * 200_000, "T")
        assert (top, filled) == (0, [0, 1, 2])
    assert time.time() - began < 60


def test_shared_sentences(spark):
    """A sentence that many pages share stays between what is the page's own, and goes above the title and at the end."""
    rows = [("h", k, f"T {chr(97 + k)}", f"We use cookies here.\n# T {chr(97 + k)}\nNote: read this first.\nOwn {chr(97 + k)} text.\nAll is without warranty.") for k in range(10)]
    got = {(r.page_id, r.line_no) for r in bp.template_lines(spark.createDataFrame(rows, "host string, page_id long, title string, raw_text string")).collect()}
    assert got == {(k, n) for k in range(10) for n in (0, 4)}

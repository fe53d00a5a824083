import random
import re
from collections import defaultdict

import pytest

from loamdex.llm import repeated_lines as rl

SCHEMA = "source string, page_id long, sections array<struct<heading_path string, content string>>, lines int, block string"


def brute(rows, least_pages=5, least_chars=15):
    norm = lambda x: re.sub("[0-9]+", "0", re.sub(r"\s+", " ", x).strip())
    on, occ = defaultdict(set), set()
    for source, page, sections in rows:
        for s, sec in enumerate(sections or []):
            for k, line in enumerate((sec[1] or "").split("\n")):
                if source is not None and page is not None and len(norm(line)) >= least_chars:
                    on[source, norm(line).upper().lower()].add(page)
                    occ.add((source, norm(line).upper().lower(), page, s, k))
    return {o[2:] for o in occ if len(on[o[:2]]) >= least_pages}


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_against_brute_force(spark, partitions):
    rng = random.Random(7)
    common = [f"Common furniture line number {k}" for k in range(12)]
    rows = []
    for page in range(60):
        lines = [rng.choice(common) if rng.random() < 0.5 else f"unique line {rng.random()} of words x{chr(97 + page % 26)}" for _ in range(12)] + ["share this page now"] * rng.randint(0, 2) + ["", "short"]
        lines = [x.upper() if rng.random() < 0.3 else " " + x.replace(" ", "  ") + " " if rng.random() < 0.3 else x for x in lines]
        rows.append((rng.choice(["s1", "s1", "s2", None]), page, [("h", "\n".join(lines[:6])), ("h", "\n".join(lines[6:])), ("h", None)]))
    rows += [rows[0], ("s1", 100, None), ("s1", 101, []), ("s1", 102, [("h", "")]), ("s2", 103, [("h", "very long line " * 20_000)]), (None, None, [("h", common[0])])]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
        found = rl.repeated_lines(df)
        got = [(r.page_id, r.section_no, r.line_no) for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows)
        clean = {(r.page_id, r.section_no): r.content for r in rl.without_lines(df, found).collect()}
        gone = brute(rows)
        for _, page, sections in rows[:60]:
            for s, sec in enumerate(sections[:2]):
                assert clean[page, s] == "\n".join(x for k, x in enumerate(sec[1].split("\n")) if (page, s, k) not in gone)
        assert rl.repeated_lines(df.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_blocks_of_several_lines(spark):
    block = ["first line of the block", "second line of the block", "third line of the block"]
    rows = [("s", k, [("h", "\n".join([f"own text {'abcdefgh'[k]} of page", *block, f"more text {'abcdefgh'[k]} here"]))]) for k in range(6)]
    got = {(r.page_id, r.line_no): r.lines for r in rl.repeated_lines(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)).collect()}
    assert got == {(k, 1 + j): 3 - j for k in range(6) for j in range(3)}


def longest_blocks(rows, least_pages=5):
    """(page, line) to the lines of the longest run that starts there and is on enough pages; every line counts."""
    pages, best = defaultdict(set), {}
    for _, page, sections in rows:
        lines = sections[0][1].split("\n")
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                pages[tuple(lines[a:b])].add(page)
    for _, page, sections in rows:
        lines = sections[0][1].split("\n")
        for a in range(len(lines)):
            n = max((b - a for b in range(a + 1, len(lines) + 1) if len(pages[tuple(lines[a:b])]) >= least_pages), default=0)
            if n:
                best[page, a] = n
    return best


@pytest.mark.parametrize("depths", [(2, 3), (6, 32, 128)])
def test_blocks_of_any_length(spark, depths):
    """Blocks of 1 to 50 lines, nested and cut short on some pages: lengths are those of brute force."""
    rng = random.Random(3)
    block = [f"line {'abcdefghijklmnopqrstuvwxyz'[k % 26]}{k * 'i'} of a long block" for k in range(50)]
    rows = []
    for page in range(24):
        n, start = rng.choice([50, 50, 37, 9, 7, 6, 2]), rng.choice([0, 0, 5])
        own = [f"own words {rng.random()} of page {'abcdefghijklmnopqrstuvwxyz'[page]} {x}" for x in ("eins", "zwei")]
        rows.append(("s", page, [("h", "\n".join([own[0], *block[start : start + n], own[1]]))]))
    found = rl.repeated_lines(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA), depths=depths)
    got = {(r.page_id, r.line_no): r.lines for r in found.collect()}
    want = longest_blocks([(s, p, [(h, re.sub("[0-9]+", "0", t)) for h, t in x]) for s, p, x in rows])
    assert got == want and max(want.values()) > 40
    blocks = {(r.page_id, r.line_no): r.lines for r in rl.repeated_blocks(found).collect()}
    assert blocks == {(p, a): n for (p, a), n in want.items() if n >= 2 and want.get((p, a - 1), 0) <= n}


def test_tasks_grow_with_the_rows():
    assert [rl.tasks_for(n, 8) for n in (0, 1, 200_001, 3_000_000, 10_000_000, 100_000_000)] == [1, 1, 2, 8, 8, 50]


@pytest.mark.parametrize("keys", [5, 60])
def test_rows_do_not_depend_on_tasks(spark, monkeypatch, keys):
    """Many small tasks, so that blocks reach over their edges: the rows of brute force."""
    monkeypatch.setattr(rl, "TASK_KEYS", keys)
    monkeypatch.setattr(rl, "LEAST_KEYS", keys)
    rng = random.Random(5)
    common = [f"Common furniture line {x}" for x in "abcdef"]
    rows = [("s", p, [("h", "\n".join(rng.choice([*common, f"own words {chr(97 + p)} and more"]) for _ in range(8)))]) for p in range(12)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    assert {(r.page_id, r.section_no, r.line_no) for r in rl.repeated_lines(df, depths=(3, 2)).collect()} == brute(rows)


def test_website_spelling(spark):
    df = spark.createDataFrame([("https://Docs.A.example/x/",), ("http://docs.a.example/x",)], "u string")
    assert {r.w for r in df.select(rl.website(df.u).alias("w")).collect()} == {"docs.a.example/x"}

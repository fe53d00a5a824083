import re
from itertools import combinations

import numpy as np

from loamdex.llm import near_duplicates as nd


def brute(rows, shingle=3, threshold=0.6, least=20):
    sets = {}
    for i, t in rows:
        w = re.findall("[a-z0-9]+", (t or "").lower())
        if i is not None and len(w) >= max(least, shingle):
            sets[i] = {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}, sets


def test_against_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/embedding_records.parquet")
    truth, sets = brute([(r.id, r.content) for r in df.select("id", "content").collect()])
    got = [(r.id_a, r.id_b) for r in nd.p2_found(spark, sf).collect()]
    assert len(got) == len(set(got))
    assert set(got) <= truth and len(set(got)) >= 0.98 * len(truth) > 0
    groups = nd.p2_groups(spark, sf).collect()
    assert {g.id for g in groups} == set(sets) and len(groups) == len(sets)
    of = {g.id: g.group_id for g in groups}
    assert all(of[a] == of[b] for a, b in got)


def test_defined_cases(spark):
    words = [f"w{k}" for k in range(40)]
    text = " ".join(words)
    edited = " ".join(words[:20] + ["new"] + words[20:])
    long = " ".join(f"z{k}" for k in range(30_000))
    rows = [("a", text), ("b", text.upper().replace(" ", ", ")), ("b", text), ("c", edited), ("d", None), ("e", ""), ("f", "too short"), (None, text), ("g", long), ("h", long + " end"), ("i", "é" * 50)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "id string, content string, fp int, sig string")
    got = sorted((r.id_a, r.id_b) for r in nd.near_duplicate_pairs(df, "id", "content", shingle=3, threshold=0.6, least_words=20).collect())
    assert got == [("a", "b"), ("a", "c"), ("b", "c"), ("g", "h")]
    groups = {r.id: r for r in nd.near_duplicate_groups(df, "id", "content", shingle=3, threshold=0.6, least_words=20).collect()}
    assert set(groups) == set("abcgh") and groups["a"].class_id == groups["b"].class_id != groups["c"].class_id
    assert groups["a"].links == groups["c"].links == 1 and groups["a"].group_id == groups["c"].group_id != groups["g"].group_id
    assert nd.near_duplicate_pairs(df.limit(0), "id", "content").count() == 0


def test_hot_buckets_lose_no_link(spark):
    """Texts of one family share many buckets; cut into parts they give the same pairs."""
    base = [f"w{k}" for k in range(60)]
    rows = [(f"{k:03}", " ".join(base[:k] + [f"new{k}"] + base[k:])) for k in range(60)]
    df = spark.createDataFrame(rows, "id string, content string")
    truth, _ = brute(rows)
    for bucket_rows in (7, 4096):
        got = [(r.id_a, r.id_b) for r in nd.near_duplicate_pairs(df, "id", "content", shingle=3, threshold=0.6, least_words=20, bucket_rows=bucket_rows).collect()]
        assert len(got) == len(set(got)) and set(got) == truth


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(f"{k:03}", f"{k + 1:03}") for k in range(60)] + [("x", "y")], "a string, b string")
    got = {r.node: r.root for r in nd.components(links).collect()}
    assert {got[f"{k:03}"] for k in range(1, 61)} == {"000"} and got["y"] == "x"


def test_posterior_bounds_are_safe():
    least = nd.keep_from(0.6, 16, 64, 1e-4)
    rng = np.random.default_rng(0)
    equal = rng.random((20_000, 64)) < 0.6 + 0.4 / 256
    lost = np.zeros(len(equal), bool)
    for n, m in enumerate(least):
        lost |= equal[:, : 16 * (n + 1)].sum(1) < m
    assert lost.mean() < 0.01 and least == sorted(least)


def test_large_classes_are_joined_in_parts(spark):
    """Two linked classes of many members, cut into parts or not: the same pairs, each once."""
    words = [f"w{k}" for k in range(40)]
    a, b = " ".join(words), " ".join(words[:20] + ["new"] + words[20:])
    df = spark.createDataFrame([(f"{k:02}", (a, b, b + " own words of one" * 9)[min(k % 3, 2 if k == 5 else k % 2)]) for k in range(24)], "id string, content string")
    truth, _ = brute([(r.id, r.content) for r in df.collect()])
    for n in (3, 4096):
        got = [(r.id_a, r.id_b) for r in nd.near_duplicate_pairs(df, "id", "content", shingle=3, threshold=0.6, least_words=20, part_rows=n).collect()]
        assert len(got) == len(set(got)) and set(got) == truth


def test_similarities():
    rng = np.random.default_rng(1)
    sets = [[bytes(rng.integers(0, 3, nd._KEPT, np.uint8)) for _ in range(rng.integers(1, 60))] for _ in range(80)]
    xs, ys = [sorted(set(x)) for x in sets[:40]], [sorted(set(x)) for x in sets[40:]]
    got = nd.similarities([b"".join(x) for x in xs], [b"".join(y) for y in ys])
    assert got.tolist() == [len(set(x) & set(y)) / len(set(x) | set(y)) for x, y in zip(xs, ys, strict=True)]

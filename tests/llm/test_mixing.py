import os

import pytest

from loamdex.llm import mixing as mx
from loamdex.llm.tokens import VOCABULARY, encoder

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")


def test_steps_invert_the_distribution():
    steps = mx.steps_of(1.0, 3)
    assert [round(s, 4) for s in steps] == [0.3679, 0.7358, 0.9197]
    assert mx.calibrated(mx.Draws({1: 10}), 1e9, 4).tolist() == [0.0] * 4 and len(mx.calibrated(mx.Draws({1: 10}), 0, 4)) == 0
    many = mx.steps_of(5000.0, 10**9)
    assert 0.49 < many[5000] < 0.51 and many[-1] < 1 and len(many) < 10_000


def test_any_rate_is_met(spark):
    """Rates from a hundred thousandth to hundreds of repeats, over ten million documents and over few."""
    for n, rate, most in ((10_000_000, 1e-5, 3), (10_000_000, 1e-4, 1), (1_000_000, 0.37, 4), (200, 700.0, 2000)):
        rows = spark.range(n).select(mx.F.lit("a").alias("source"), mx.draw(17, mx.F.col("id")).alias("draw"), mx.F.lit(7).cast("long").alias("n_tokens"))
        goals = spark.createDataFrame(mx.plan_of(rows, [("a", rate, most)]), mx._STEPS)
        got = mx._copies(rows, goals).agg(mx.F.sum("copies").alias("n"), mx.F.max("copies").alias("m")).first()
        assert abs(got.n - n * rate) <= max(1, 0.002 * n * rate) and got.m <= most


def test_sizes_that_differ_much(spark):
    """Off by no more than half of the largest document."""
    rows = spark.range(400).select(mx.F.lit("a").alias("source"), mx.draw(17, mx.F.col("id")).alias("draw"), mx.F.expr("if(id % 7 = 0, 3000 + id, 5 + id % 50)").cast("long").alias("n_tokens"))
    total = rows.agg(mx.F.sum("n_tokens")).first()[0]
    for share in (0.02, 0.3, 0.9, 1.7):
        goals = spark.createDataFrame(mx.plan_of(rows, [("a", share, 3)]), mx._STEPS)
        got = mx._copies(rows, goals).agg(mx.F.sum(mx.F.col("copies") * mx.F.col("n_tokens"))).first()[0]
        assert abs(got - share * total) <= 1710


def test_shares(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    copies = mx.p7_mixture(spark, sf)
    rows = copies.select("doc_id", "source", "copy_no", "n_tokens").collect()
    assert len({(r.doc_id, r.copy_no) for r in rows}) == len(rows)
    goals = {r.source: r for r in mx.p7_shares(spark, sf).collect()}
    for s, g in goals.items():
        used = [r for r in rows if r.source == s]
        assert sum(r.n_tokens for r in used) == g.reached_tokens
        assert max((r.copy_no for r in used), default=0) == g.most_copies <= g.max_repeats
        if g.documents > 20:
            assert abs(g.reached_tokens - g.target_tokens) < 0.06 * g.target_tokens
    assert abs(sum(g.reached_share for g in goals.values()) - 1) < 1e-9
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mx.p7_mixture(spark, sf).select("doc_id", "source", "copy_no", "n_tokens").collect()))


def test_defined_cases(spark):
    docs = [(k, f"word number {k} of a text", "  Big.Example ") for k in range(300)] + [(1000 + k, "small one", "SMALL.example") for k in range(4)]
    docs += [(2000, None, "big.example"), (2001, "", "big.example"), (2002, "x", None), (2003, "x", "unlisted"), (2004, "tiny " * 10_000, "long.example")]
    df = spark.createDataFrame([(*d, 3, "x") for d in docs], "doc_id long, text string, source string, n_tokens int, steps string")
    targets = spark.createDataFrame([("big.example", 0.5, 2), (" Small.Example", 0.4, 3), ("long.example", 0.1, 1), ("absent", 0.0, 4), (None, 0.1, 1)], "source string, target_share double, max_repeats long")
    got = {r.source: r for r in mx.shares(df, targets).collect()}
    assert set(got) == {"big.example", "small.example", "long.example", "absent"}
    assert got["small.example"].reached_tokens == 3 * got["small.example"].source_tokens and got["small.example"].most_copies == 3
    assert got["big.example"].source_tokens == sum(len(encoder(VOCABULARY)(t)) for _, t, s in docs if t and s and s.strip().lower() == "big.example")
    assert got["absent"].reached_tokens == 0
    assert mx.mixture(df.limit(0), targets).count() == 0 and mx.mixture(df, targets.limit(0)).count() == 0

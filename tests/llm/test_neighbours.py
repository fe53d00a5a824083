import numpy as np

from loamdex.llm import neighbours as nb


def brute(ids, x, k=8, least=0.7):
    order = np.argsort(ids, kind="stable")
    ids, x = [ids[i] for i in order], x[order].astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 9)
    np.fill_diagonal(s, -9)
    out = set()
    for i in range(len(ids)):
        for j in np.argsort(-s[i], kind="stable")[:k]:
            if s[i, j] >= least:
                out.add((ids[min(i, j)], ids[max(i, j)]))
    return out


def usable(df):
    seen = {}
    for r in df.select("id", "vector").collect():
        v = np.array(r.vector if r.vector is not None else [], np.float64)
        if len(v) == 96 and np.isfinite(v).all() and v.any():
            seen[r.id] = v
    return list(seen), np.stack(list(seen.values()))


def test_recall_against_brute_force(spark, sf):
    ids, x = usable(spark.read.parquet(f"{sf}/embedding_records.parquet"))
    truth = brute(ids, x)
    got = [(r.id_a, r.id_b) for r in nb.p1_found(spark, sf).collect()]
    assert len(got) == len(set(got))
    assert len(truth & set(got)) >= 0.95 * len(truth) > 0


def test_defined_cases(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=8)
    rows = [(f"d{k:02}", (base * (k + 1)).tolist()) for k in range(14)]  # one class of fourteen, in several lengths
    rows += [("n1", (base + 0.05 * rng.normal(size=8)).tolist()), ("n2", rng.normal(size=8).tolist())]
    good = list(rows)
    rows += [rows[0], ("bad1", None), ("bad2", []), ("bad3", [0.0] * 8), ("bad4", [float("nan")] * 8), ("bad5", [float("inf")] + [1.0] * 7), ("bad6", [1.0] * 7), ("bad7", [None] + [1.0] * 7), (None, base.tolist())]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "id string, vector array<float>, key int, code string")
    got = [(r.id_a, r.id_b) for r in nb.nearest_pairs(df, width=8, k=8, least=0.7, tables=8, probes=4).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute([i for i, _ in good], np.array([v for _, v in good]))
    assert nb.nearest_pairs(df.limit(0), width=8).count() == 0


def test_hot_buckets_are_divided(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(3, 16))
    x = np.concatenate([c + 0.3 * rng.normal(size=(60, 16)) for c in centres])
    ids = [f"{k:03}" for k in range(len(x))]
    df = spark.createDataFrame(list(zip(ids, x.tolist(), strict=True)), "id string, vector array<float>")
    got = {(r.id_a, r.id_b) for r in nb.nearest_pairs(df, width=16, k=4, least=0.7, tables=6, probes=6, bucket_rows=40).collect()}
    truth = brute(ids, x, 4)
    assert len(truth & got) >= 0.95 * len(truth)


def test_full_buckets_lose_no_pair(spark):
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(150, 32)), 4, axis=0)
    x += 0.35 * rng.normal(size=x.shape)
    df = spark.createDataFrame([(f"{k:03}", v) for k, v in enumerate(x.tolist())], "id string, vector array<float>")
    whole, cut = ([(r.id_a, r.id_b) for r in nb.nearest_pairs(df, width=32, k=4, bucket_rows=n).collect()] for n in (8192, 8))
    assert len(cut) == len(set(cut)) > 0
    assert set(cut) == set(whole)


def test_dense_cluster_has_its_nearest(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=32) + 0.1 * rng.normal(size=(600, 32))  # cosines of about 0.99
    ids = [f"{k:03}" for k in range(len(x))]
    df = spark.createDataFrame(list(zip(ids, x.tolist(), strict=True)), "id string, vector array<float>")
    got = {(r.id_a, r.id_b) for r in nb.nearest_pairs(df, width=32, k=4, bucket_rows=50).collect()}
    truth = brute(ids, x, 4)
    assert len(truth & got) >= 0.99 * len(truth)


def test_two_large_classes_near_each_other(spark):
    """A third of all records equal, another third equal and near them, and a few whose nearest are both: work is by class, rows are those of brute force."""
    rng = np.random.default_rng(8)
    a = rng.normal(size=16)
    b = a + 0.2 * rng.normal(size=16)
    x = np.concatenate([np.repeat([a, b], 40, axis=0), a + 0.1 * rng.normal(size=(12, 16)), np.repeat([a + 0.15 * rng.normal(size=16)], 5, axis=0)])
    ids = [f"{k:03}" for k in rng.permutation(len(x))]
    df = spark.createDataFrame(list(zip(ids, x.tolist(), strict=True)), "id string, vector array<float>")
    for n in (8192, 3):
        got = [(r.id_a, r.id_b) for r in nb.nearest_pairs(df, width=16, k=8, tables=6, probes=4, bucket_rows=n).collect()]
        assert len(got) == len(set(got))
        assert set(got) == brute(ids, x)


def test_one_id_with_two_vectors(spark):
    """Each of the two counts; the exact comparison takes the vector that was asked for."""
    v = [1.0] + [0.0] * 7
    rows = [("a", v), ("b", v[::-1]), ("b", [0.7000001, 0.7141427] + [0.0] * 6), ("c", [0.7] + [0.0] * 6 + [0.71414284])]
    got = {(r.id_a, r.id_b) for r in nb.nearest_pairs(spark.createDataFrame(rows, "id string, vector array<float>"), width=8, tables=8, probes=8).collect()}
    assert ("a", "b") in got and ("b", "c") in got

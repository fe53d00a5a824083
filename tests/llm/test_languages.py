import random

import numpy as np
import pytest

from loamdex.llm import languages as ls


@pytest.fixture(scope="module")
def tables(spark, sf):
    read = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    return read("documents"), read("lang_samples"), read("lang_codes")


@pytest.fixture(scope="module")
def model(tables):
    return ls.fitted(*tables)


def test_held_out_samples(tables):
    """Every other sample is certain to the model, the rest is held out."""
    rows = sorted((r.sample_id, r.lang, r.sample_text) for r in tables[1].collect())
    labeller = ls.Labeller(ls.fit([r[1:] for r in rows[::2]], []))
    held = rows[1::2]
    right = sum([s[2] for s in labeller.segments([text])[0]] == [lang] for _, lang, text in held)
    assert right >= 0.95 * len(held)


def test_mixed_samples(tables, model):
    rows = sorted((r.sample_id, r.lang, r.sample_text) for r in tables[1].collect())
    labeller = ls.Labeller(model)
    wrong = 0
    for (_, la, a), (_, lb, b) in zip(rows, rows[40:] + rows[:40], strict=True):
        text = f"```\nx = 1\n\ny = 2\n```\n\n{a}\r\n \r\n# {a}\n\n- {b}\n\n```\nend\n```\n"
        got = [(s, e, lang) for s, e, lang, _ in labeller.segments([text])[0]]
        wrong += got != ([(0, 3, la), (4, 5, lb)] if la != lb else [(0, 5, la)])
    assert wrong <= 2


def test_cases(model):
    labeller = ls.Labeller(model)
    for text in (None, "", " \n\t\n", "```\ncode here and more words\n```", "`only_code`", "# someName", "12 34"):
        assert labeller.segments([text, None]) == labeller.spans([text]) + [[]] == [[], []]
    plain = "The server reads the list of all open connections and stores it before the next restart."
    assert [s[2] for s in labeller.segments([plain.upper()])[0]] == ["en"]
    quoted = plain + " “Die Anwendung prüft die geänderten Seiten vor dem Speichern und nach dem Neustart der Warteschlange.”"
    assert [s[2] for s in labeller.segments([quoted])[0]] == ["en"]
    long = (plain + "\n\n") * 3000
    assert [s[:3] for s in labeller.segments([long])[0]] == [(0, 2999, "en")]
    assert ls.blocks_of("```\na b\n\nplain words") == [[], ["plain", "words"]]


def test_rows(spark, sf, tables, model):
    _, _, codes = tables
    en = "The server reads the list of all open connections and stores it before the next restart."
    rows = [(1, en, "en"), (2, en, " EN-us"), (3, en, "English"), (4, en, "german"), (5, en, None), (6, None, "en"), (7, en, "eng"), (8, en, "en_"), (9, en, "enx-US"), (4, en, "german")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, label string")
    found = ls.names_language(ls.F.col("label"), ls.F.col("lang"), codes, ls.language_segments(df, model))
    assert sorted((r.doc_id, r.agrees) for r in found.collect()) == [(1, True), (2, True), (3, True), (4, False), (4, False), (5, False), (7, True), (8, False), (9, False)]
    assert ls.language_segments(df.limit(0), model).count() == 0
    got = ls.p8_found(spark, sf).collect()
    assert got and len(got) == len({(r.doc_id, r.block_no) for r in got})


def test_all_samples_count(spark, tables):
    samples = spark.range(100_001).selectExpr("id as sample_id", "if(id < 100000, 'en', 'xx') as lang", "if(id < 100000, 'the house', 'ena hisa') as sample_text")
    assert ls.fitted(tables[0].limit(0), samples, tables[2]).langs == ["en", "xx"]


def plain_viterbi(words, penalty):
    """The best path, one word and state at a time."""
    value, back = [0.0] * words.shape[1], []
    for row, p in zip(words, penalty, strict=True):
        top = max(range(len(value)), key=lambda k: (value[k], -k))
        back.append([k if value[k] >= value[top] - p else top for k in range(len(value))])
        value = [max(v, value[top] - p) + float(x) for v, x in zip(value, row, strict=True)]
    path, q = [], max(range(len(value)), key=lambda k: (value[k], -k))
    for came in reversed(back):
        path.append(q)
        q = came[q]
    return path[::-1]


def test_best_path():
    """All texts of a step at once give what one text after another gives."""
    rng = np.random.default_rng(3)
    lengths = np.array([1, 7, 40, 7, 200, 2])
    starts = np.cumsum([0, *lengths[:-1]])
    scores = -rng.integers(0, 64, (lengths.sum(), 5)).astype(np.float32) / 8  # sums are exact
    penalty = rng.choice(np.array([4, 12], np.float32), lengths.sum())
    penalty[starts] = 0
    got = ls.best_path(scores, penalty, starts, lengths)
    for s, n in zip(starts, lengths, strict=True):
        assert got[s : s + n].tolist() == plain_viterbi(scores[s : s + n], penalty[s : s + n])


def test_spans_inside_blocks(tables, model):
    """Texts of several languages without a blank line: spans begin where the language changes, within two words."""
    rng = random.Random(7)
    by: dict[str, list[str]] = {}
    for r in sorted(tables[1].collect(), key=lambda r: r.sample_id):
        by.setdefault(r.lang, []).append(r.sample_text)
    labeller, near, all_ = ls.Labeller(model), 0, 0
    for _ in range(60):
        langs = rng.sample(sorted(by), 3)
        texts = [" ".join(rng.sample(by[lang], 2)) for lang in langs]
        joined = "\n".join(texts)
        got = labeller.spans([joined])[0]
        sizes = np.cumsum([0] + [sum(map(len, labeller.words_of(t))) for t in texts])[:-1]
        all_ += 1
        near += [s[4] for s in got] == langs and all(abs(s[1] - n) <= 2 for s, n in zip(got, sizes, strict=True))
        assert all(s[0] == s[2] == 0 for s in got) and all(a[3] + 1 == b[1] for a, b in zip(got, got[1:]))
    assert near >= 0.9 * all_


def test_many_texts_in_steps(spark, model, monkeypatch):
    """The rows don't depend on how texts are put together in steps."""
    texts = ["The server reads the list of all open connections.\n\nDie Anwendung prüft die geänderten Seiten vor dem Speichern." * k for k in (1, 3, 9)] * 20
    df = spark.createDataFrame([(k, "x", t) for k, t in enumerate(texts)], "doc_id long, lang string, text string").coalesce(1)
    rows = lambda: sorted(tuple(r) for r in ls.language_segments(df, model).collect())
    whole = rows()
    monkeypatch.setattr(ls, "STEP_BYTES", 1)
    assert rows() == whole and len(whole) > 60

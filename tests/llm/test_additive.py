import os
import zlib

import numpy as np
import pytest

from support import DATA
from veriframe.llm import additive as A
from veriframe.llm import queries as Q


def auc(scores, labels):
    order = np.argsort(np.argsort(scores))
    ones = labels.sum()
    return (order[labels == 1].sum() - ones * (ones - 1) / 2) / (ones * (len(labels) - ones))


def slow_score(model, row):
    """A score by plain additions of what the row falls into, one table after the other."""
    total = model.intercept
    at = [sum(bool(v >= e) for e in edges) for v, edges in zip(row, model.edges, strict=True)]
    for i, t in zip(at, model.tables, strict=True):
        total += t[i]
    coarse = [i * A.PAIR_BINS // max(A.PAIR_BINS, len(t)) for i, t in zip(at, model.tables, strict=True)]
    for i, j, t in model.pairs:
        total += t[coarse[i], coarse[j]]
    return 1 / (1 + np.exp(-total))


def test_interactions_are_learned():
    """Neither statistic tells anything alone: only the table of the pair can."""
    rng = np.random.default_rng(5)
    x = rng.random((4000, 4))
    y = ((x[:, 1] > 0.5) ^ (x[:, 3] > 0.5)).astype(float)
    model = A.train(x[:3000], y[:3000], np.ones(3000))
    assert auc(model.scores(x[3000:]), y[3000:]) > 0.95
    assert {1, 3} in [{i, j} for i, j, _ in model.pairs]
    model.pairs = []
    assert auc(model.scores(x[3000:]), y[3000:]) < 0.6


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(6)
    x = np.round(rng.random((600, 5)), 2)  # with ties at the edges
    y = (x[:, 0] + 0.3 * x[:, 1] * x[:, 2] + 0.1 * rng.random(600) > 0.7).astype(float)
    model = A.train(x, y, np.ones(600))
    assert np.allclose(model.scores(x), [slow_score(model, r) for r in x])


def brute_cut(g, h):
    """The best first cut of a tree, every cut tried."""
    worth = lambda k: g[k].sum() ** 2 / (h[k].sum() + A.SMOOTH)
    n = np.arange(len(g))
    fits = [k for k in range(1, len(g)) if h[:k].sum() >= A.LEAST_WEIGHT and h[k:].sum() >= A.LEAST_WEIGHT]
    return max((worth(n < k) + worth(n >= k), k) for k in fits)[1]


def test_trees_against_all_cuts(monkeypatch):
    rng = np.random.default_rng(7)
    monkeypatch.setattr(A, "LEAVES", 2)
    for _ in range(20):
        g, h = rng.normal(size=12), rng.random(12) * 20
        values = A._tree(g, h)
        cut = brute_cut(g, h)
        assert np.allclose(values[:cut], g[:cut].sum() / (h[:cut].sum() + A.SMOOTH)) and np.allclose(values[cut:], g[cut:].sum() / (h[cut:].sum() + A.SMOOTH))
        g, h = rng.normal(size=(5, 6)), rng.random((5, 6)) * 20
        quarters = lambda a, b: [(np.s_[:a, :b]), (np.s_[:a, b:]), (np.s_[a:, :b]), (np.s_[a:, b:])]
        gain, a, b = max((sum(g[q].sum() ** 2 / (h[q].sum() + A.SMOOTH) for q in quarters(a, b)), a, b) for a in range(1, 5) for b in range(1, 6))
        found, cells = A._pair_tree(g, h)
        assert np.isclose(found, gain) and all(np.allclose(cells[q], g[q].sum() / (h[q].sum() + A.SMOOTH)) for q in quarters(a, b))


def test_statistics_of_odd_texts():
    for text in (None, ""):
        assert not A.statistics_of(text).any()
    for text in (" ", "\n\n", "\x00", "é", "a", "#", "\ud800", "a b c d e " * 50_000, "x" * 1_000_000):
        s = A.statistics_of(text)
        assert np.isfinite(s).all() and len(s) == len(A.FEATURES)
    s = dict(zip(A.FEATURES, A.statistics_of("The end. THE END!\nthe end\nthe end"), strict=True))
    assert s["repeated_lines"] == pytest.approx(1 / 3) and s["capital_starts"] == pytest.approx(3 / 8) and s["distinct_words"] == pytest.approx(6 / 8)
    s = dict(zip(A.FEATURES, A.statistics_of("a b c d e f a b c d e f"), strict=True))
    assert s["repeated_windows"] == pytest.approx(4 / 8)


def test_edges(spark):
    schema = "doc_id long, text string, score string, label int, id int, statistics int"
    rows = [(i, "good words stand here in order" if i % 2 else "### $$$ %%%", "own", 1, 2, 3) for i in range(60)]
    rows += [(None, None, "own", 1, 2, 3), (None, "", "own", 1, 2, 3), (3, "two texts of an id", "own", 1, 2, 3), (3, "two texts of an id", "own", 1, 2, 3), (99, "long " * 100_000, "own", 1, 2, 3)]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(1, 1, 0), (2, None, 0), (None, 1, 0), (4, 7, 0)], "doc_id long, quality int, toxic int")
    model = A.fit(docs, labels)
    got = A.score(docs, model)
    assert got.columns == ["doc_id", "text", "label", "id", "statistics", "score", "predicted"] and got.count() == len(rows)
    for r in got.collect():
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    marks = {r["text"]: r["score"] for r in got.collect()}
    assert marks["### $$$ %%%"] < 0.3 < marks["good words stand here in order"]
    assert A.score(docs.limit(0), model).count() == 0
    # Without labels, or with one only, there is nothing to tell apart.
    assert {r["score"] for r in A.score(docs, A.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert len({r["score"] for r in A.score(docs, A.fit(docs, labels.filter("quality = 1"))).collect()}) == 1
    assert A.fit(docs.limit(0), labels).scores(np.zeros((1, len(A.FEATURES)))).tolist() == [0.5]
    # A sample of some rows of each label keeps the labels' shares, and is the same each time.
    few = [A.fit(docs, labels, per_label=20) for _ in range(2)]
    assert few[0].intercept == few[1].intercept and abs(few[0].scores(np.stack([A.statistics_of(r[1]) for r in rows[:60]])).mean() - 0.5) < 0.2


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_held_out_accuracy(spark):
    folder = DATA.replace("0.001", "0.01")
    found = Q.op12_quality_classifier(spark, folder)
    assert found.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = {r["doc_id"]: r for r in found.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if rows[r["doc_id"]]["held_out"]]
    scores, truth = np.array([rows[i]["score"] for i, _ in labels]), np.array([q for _, q in labels])
    assert auc(scores, truth) > 0.97 and ((scores >= 0.3) == truth)[truth == 1].mean() > 0.97

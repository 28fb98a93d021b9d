import random

import numpy as np
from pyspark.sql import functions as F

from veriframe.llm import html_extract as H
from veriframe.llm import language_id as L
from veriframe.llm import neighbours as N


def corpus(n, seed=0):
    rng = random.Random(seed)
    parts = {"aa": ["ban", "tor", "lis", "mek"], "bb": ["ñu", "zio", "que", "ará"], "cc": ["sch", "ung", "öß", "tz"]}
    out = []
    for i in range(n):
        lang = rng.choice(list(parts))
        out.append((i, " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(3, 80))), lang))
    return out


def test_messages_against_full_enumeration():
    rng = np.random.default_rng(0)
    sizes = np.array([1, 3, L.BLOCK, L.BLOCK + 1, 70])
    k = 3
    scores, transition, start = rng.normal(size=(sizes.sum(), k)), rng.normal(size=(k, k)), rng.normal(size=k)
    gamma, counts, first = L.Chains(sizes).marginals(scores, transition, start, pairs=True)
    at, want_counts, want_first = 0, np.zeros((k, k)), np.zeros(k)
    for m in sizes:
        x = scores[at : at + m]
        a, b = np.zeros((m, k)), np.zeros((m, k))
        a[0] = start + x[0]
        for i in range(1, m):
            a[i] = np.logaddexp.reduce(a[i - 1][:, None] + transition, axis=0) + x[i]
        for i in range(m - 2, -1, -1):
            b[i] = np.logaddexp.reduce(transition + x[i + 1] + b[i + 1], axis=1)
        z = np.logaddexp.reduce(a[-1])
        p = np.exp(a + b - z)
        assert np.allclose(p, gamma[at : at + m])
        want_first += p[0]
        for i in range(1, m):
            want_counts += np.exp(a[i - 1][:, None] + transition + x[i] + b[i] - z)
        at += m
    assert np.allclose(counts, want_counts) and np.allclose(first, want_first)


def test_language_held_out_and_switched(spark, docs):
    rows = corpus(240)
    model = L.train([t for _, t, _ in rows[:180]], [y for *_, y in rows[:180]])
    names, scores = model.classify([t for _, t, _ in rows[180:]])
    assert np.mean([a == y for a, (*_, y) in zip(names, rows[180:], strict=True)]) > 0.98 and (scores <= 1).all()
    switched = "bantor lismek torban meklis bantor " * 3 + "schung ößtz ungsch tzung schöß " * 3
    marginals, words = model.label([switched])
    labels = [model.languages[i] for i in marginals[0].argmax(axis=1)]
    assert labels == ["aa"] * 15 + ["cc"] * 15 and len(words[0]) == 30


def test_language_edges(spark, docs):
    rows = corpus(60)
    table = docs([(i, t, y, "s") for i, t, y in rows] + [(None, None, "aa", None), (901, "", None, None), (902, "123 !? _²", "bb", None), (903, "tor " * 30_000, None, None)])
    table = table.withColumn("score", F.lit("clash"))
    out = L.predict(table, L.fit(table, 20)).collect()
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in out}
    assert len(out) == 64 and got[None] == ("und", 0.0) and got[901] == ("und", 0.0) and got[902] == ("und", 0.0) and got[903][0] == "aa"
    empty = table.limit(0)
    assert L.predict(empty, L.fit(empty)).count() == 0
    assert {r["lang_pred"] for r in L.predict(table, L.fit(empty)).collect()} == {"und"}


def exact(x, ids, q, k):
    d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
    d[ids == q] = np.inf
    order = np.lexsort((ids, d))[:k]
    return [(int(ids[i]), float(d[i])) for i in order if np.isfinite(d[i])]


def test_neighbours_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (12, 16))
    x = (centres[rng.integers(0, 12, 1500)] + rng.normal(0, 0.5, (1500, 16))).astype(np.float32)
    x[100:400] = x[100]  # one very common vector
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = {}
    for r in N.search(df, df.filter("vec_id % 50 = 0"), sample=800, parts=8).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ids, full, hit = np.arange(1500), x.astype(float), []
    for q in range(0, 1500, 50):
        rows = sorted(got[q])
        assert [r[0] for r in rows] == list(range(1, 11))
        for _, v, s in rows:
            assert abs(s - np.sqrt(((full[q] - full[v]) ** 2).sum())) < 1e-12
        assert rows == sorted(rows, key=lambda r: (r[2], r[1]))
        hit.append(len({v for _, v, _ in rows} & {v for v, _ in exact(full, ids, q, 10)}) / 10)
    assert np.mean(hit) >= 0.9
    assert [v for _, v, _ in sorted(got[150])] == list(range(100, 110))


def test_neighbours_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, []), (None, [1.0, 1.0]), (7, [0.5, 0.5]), (7, [0.5, 0.5]), (8, [float("inf"), 0.0]), (9, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("part", F.lit("clash"))
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in N.search(df, df, k=3).collect())
    assert got == [(0, 1, 1), (0, 2, 7), (0, 3, 7), (1, 1, 0), (1, 2, 7), (1, 3, 7), (7, 1, 1), (7, 2, 0)]
    assert N.search(df.limit(0), df).count() == 0 and N.search(df, df.limit(0)).count() == 0


def test_neighbours_on_two_levels(spark):
    """Small parts, so that each of the first classifier's has a classifier of its own."""
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (40, 12))
    x = centres[rng.integers(0, 40, 6000)] + rng.normal(0, 0.4, (6000, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4).cache()
    tree = N.fit(N.valid(df, "vec_id", "embedding"), sample=1500, part_rows=100, most_parts=8)
    assert len(tree.below) == 8 and tree.fan == 8 and np.bincount(tree.file(x), minlength=64).max() < 600
    got = {}
    for r in N.search(df, df.filter("vec_id % 60 = 0"), sample=1500, part_rows=100, most_parts=8).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    hit = [len({v for _, v in got[q]} & {v for v, _ in exact(x, np.arange(6000), q, 10)}) / 10 for q in range(0, 6000, 60)]
    assert np.mean(hit) >= 0.9


def test_sample_counts_copies_once(spark):
    common = spark.range(5000).select(F.array(F.lit(1.0), F.lit(2.0)).alias("v"))
    rest = spark.range(300).select(F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    assert len(N.drawn(common.unionByName(rest), 200)) == 200 and len(N.drawn(common, 200)) == 1


def test_recall_with_production_parameters(spark):
    """The query itself on a given table, held against brute force."""
    import pandas as pd

    from tests.support import DATA
    from veriframe.llm.queries import op10_neighbours

    data = DATA.replace("sf0.001", "sf0.1")
    table = pd.read_parquet(f"{data}/embeddings.parquet")
    x, ids = np.array(table["embedding"].tolist(), float), table["vec_id"].to_numpy()
    got = {}
    for r in op10_neighbours(spark, data).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = [len(got[q] & {v for v, _ in exact(x, ids, q, 10)}) / 10 for q in ids[ids % 100 == 0]]
    print("mean recall", np.mean(hit), "least", np.min(hit))
    assert np.mean(hit) >= 0.9


def test_words_are_letters_wherever_they_stand():
    assert L.words_of("² " * 60 + "ab") == ["ab"] and L.words_of("ab ² ³ ½") == ["ab"] and L.words_of("x²") == ["x²"]


def test_partition_is_balanced():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8))
    part = N.balanced_partition(x, N.neighbour_graph(x, 8), 8)
    assert np.bincount(part, minlength=8).max() <= 55


def test_html_held_out_layouts():
    trees = H.train(500)
    fresh = H.made_up_pages(120, seed=1234)
    got = H.texts_of(trees, [s for s, _ in fresh])
    assert np.mean([a == b for a, (_, b) in zip(got, fresh, strict=True)]) > 0.9


def test_html_without_end_tags():
    read = lambda s: (lambda p: p.text(np.ones(len(p.tag), bool)))(H.Page(s))
    article = "<article><p>One.</p><p>Two.</p></article>"
    pages = [
        f"<head><title>x</title><body>{article}", f"<head><meta charset=a><title>x</title>{article}", f"<html><head><script>'<!-- <head> <body>'</script></head><body>{article}",
        f"<form><select><option>a<option>b</form>{article}", f"<div><button>Go</div>{article}", f"<button>Go{article}", f"<object data=x>{article}<object data=y>no</object>",
        f"<svg><title>a<b</title><style>'</svg> <select>'</style><path d=1></svg>{article}", f"<button><div>Go<p>now</div></button>{article}", f"<video><source src=x>none{article}",
        f"<div><object><script>'</div>'</script><p>no</object></div>{article}", f"<select><option>a{article}<select><option>b</select>", f"<head><title>x</title><svg><g></head><body>{article}",
    ]
    assert [read(s) for s in pages] == ["One. Two."] * len(pages)
    assert read("<head><title>x</title>Bare <b>text</b>") == "Bare text" and read("<button>" * 50_000) == ""


def test_html_bare_text_in_hand_written_layouts():
    trees = H.train()
    a = "The council met on Tuesday to talk about the old bridge, which has been closed since March."
    b = "Repairs will cost more than was planned. Engineers found rust in both of the towers, and nobody knows how deep it goes."
    c = "A vote is due next week, after the public has been heard."
    nav = "<ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/s>Sport</a></li></ul>"
    foot = "<footer>&copy; 2024 The Daily Paper. All rights reserved.</footer>"
    pages = [
        f"<html><body><h1>Bridge closed</h1>{a}<br><br>{b}<br><br>{c}</body></html>",
        f"<html><head><title>t</title><body>{nav}<h1>Bridge closed</h1>{a}<br><br>{b}<br><br>{c}{foot}",
        f"<body><h2>Bridge closed</h2>\n{a}\n<br><br>\n{b} <b>{c}</b>\n<hr>\n<a href=/>Home</a> | <a href=/about>About</a></body>",
        f"<body><nav>{nav}</nav><div><h1>Bridge closed</h1>{a}<br>{b}<br>{c}</div>{foot}</body>",
    ]
    got = H.texts_of(trees, pages)
    assert got == [" ".join(["Bridge closed", a, b, c])] * len(pages)


def test_html_empty_comments_and_deep_pages():
    import time

    trees = H.train(200)
    article = "<article><h1>Bridge closed</h1><p>The bridge over the river was closed on Monday, the city said.</p><p>Repairs will take six weeks, and buses go round.</p></article>"
    nav, foot = '<nav><a href="/">Home</a></nav>', "<footer>&copy; x</footer>"
    want = H.texts_of(trees, [f"<body>{nav}{article}{foot}</body>"])[0]
    assert want.endswith("buses go round.")
    for comment in ("<!-->", "<!--->", "<!---->", "<!-- a --!>", "<!-- > -->"):
        assert H.texts_of(trees, [f"<body>{nav}{comment}{article}{foot}</body>"]) == [want]
    began = time.time()
    assert len(H.Page("<div>" * 100_000 + "x" + "</div>" * 100_000).tag) == 100_001
    assert time.time() - began < 10


def test_html_decoding_against_all_trees():
    """On small trees, decoding is held against every set of blocks that is closed upwards."""
    import itertools

    rng = np.random.default_rng(11)
    for _ in range(60):
        n = int(rng.integers(2, 9))
        page = H.Page("")
        page.tag = [H._TAGS["html"]] + [H._TAGS["div"]] * (n - 1)
        page.parent = [-1] + [int(rng.integers(0, i)) for i in range(1, n)]
        page.hint = [0] * n
        scores = rng.normal(size=n)
        kept = H.Forest([page]).decode(scores)
        best = max(
            (sum(scores[i] for i in range(1, n) if k[i]), k)
            for k in itertools.product([False, True], repeat=n)
            if k[0] and all(k[page.parent[i]] for i in range(1, n) if k[i])
        )
        assert tuple(kept) == best[1]


def test_html_edges(spark):
    trees = H.train(300)
    body = "".join(f"<p>A sentence of some words, number {i}, stands here for all to read.</p>" for i in range(8))
    pages = [
        (1, "u", None), (2, "u", ""), (3, "u", "<"), (4, "u", "<div" * 3000), (5, "u", "<div>" * 3000 + "deep"), (6, "u", "plain &amp; simple"),
        (7, "u", f"<html><body><nav><a href=x>menu</a></nav><article>{body}<!-- no --><script>if (a < b) '</p>'</script><p>x&nbsp;&lt;y&gt;\n z<b>w</b></article><footer>&copy; foot</footer>"),
        (None, None, f"<article>{body}</article>"), (None, None, f"<article>{body}</article>"), (8, "u", "<p>unclosed <b>bold <i>x" + " y" * 200_000),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = H.extract(df, trees).collect()
    got = {r["page_id"]: r["text"] for r in out}
    assert len(out) == len(pages) and got[1] == got[2] == "" and got[6] == "plain & simple"
    want = " ".join(f"A sentence of some words, number {i}, stands here for all to read." for i in range(8))
    assert got[7] == want + " x <y> zw" and got[None] == want
    assert all(r["n_chars"] == len(r["text"]) for r in out)
    assert H.extract(df.limit(0), trees).count() == 0


def test_decoding_keeps_nothing_inside_dropped_blocks():
    forest = H.Forest([H.Page("<div><p>a</p><p>b</p></div><div><p>c</p></div>")])
    kept = forest.decode(np.array([0.0, -5.0, 2.0, 2.0, -1.0, 3.0]))
    assert kept.tolist() == [False, False, False, False, True, True]

import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriframe.llm import mixing as M
from veriframe.llm import packing as K
from veriframe.llm.queries import tokenizer_path


def test_mix_rates(spark, docs):
    table = docs([(i, "x" * (10 if i % 4 else 40), "en", "a" if i % 4 else None) for i in range(4000)]).withColumn("copy", F.lit("clash"))
    out = M.mix(table, {"a": 3.0}, size_col="n_chars").groupBy("source").agg(F.sum("n_chars").alias("n")).collect()
    assert [r["source"] for r in out] == ["a"] and abs(out[0]["n"] / 70_000 - 1) < 0.06
    even = {r["source"]: r["n"] for r in M.mix(table, size_col="n_chars").groupBy("source").agg(F.sum("n_chars").alias("n")).collect()}
    assert abs(even["a"] / even[None] - 1) < 0.12
    assert M.mix(docs([])).count() == 0 and M.mix(table, {}).count() == 0


def test_mix_keeps_columns_of_any_name(spark, docs):
    table = docs([(i, "x", "en", "a") for i in range(50)])
    names = ("_u", "_n", "_s", "_cdf", "row", "u", "n", "cdf", "rate")
    for name in names:
        table = table.withColumn(name, F.lit("clash"))
    out = M.mix(table).collect()
    assert out and {r[n] for r in out for n in names} == {"clash"}


def test_counts_are_poisson(spark):
    rate = 1.7
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    counts = {r["copies"]: r["n"] for r in M.mix(df, total=rate * 20_000).groupBy("doc_id").agg(F.count(F.lit(1)).alias("copies")).groupBy("copies").agg(F.count(F.lit(1)).alias("n")).collect()}
    for k in range(1, 6):
        want = 20_000 * math.exp(-rate) * rate**k / math.factorial(k)
        assert abs(counts.get(k, 0) - want) < 5 * math.sqrt(want)
    again = M.mix(df, total=rate * 20_000)
    assert [r["mix_key"] for r in again.limit(50).collect()] == [r["mix_key"] for r in M.mix(df, total=rate * 20_000).limit(50).collect()]


def test_program_of_all_sizes_beside_a_session(spark):
    """256 sizes, as a large corpus has, in a process that has started Spark: the program ends, and near its lower bound."""
    import time

    assert spark.range(10).count() == 10
    sizes = np.arange(1, 257)
    demand = 1000.0 * np.exp(-sizes / 60)
    began = time.time()
    patterns = K.cutting_stock(sizes, demand, 256)
    assert time.time() - began < 120
    made = sum(p * x for p, x in patterns)
    assert np.all(made >= demand - 1e-3) and all((p * sizes).sum() <= 256 for p, _ in patterns)
    assert sum(x for _, x in patterns) <= 1.002 * (sizes * demand).sum() / 256
    basis = np.random.default_rng(3).integers(0, 4, (50, 50))
    assert np.abs(K._inverse(basis) @ basis - np.eye(50)).max() < 1e-9


def test_knapsack_and_program():
    rng = np.random.default_rng(0)
    for _ in range(20):
        values, weights = rng.random(3), rng.integers(1, 7, 3)
        value, counts = K._knapsack(values, weights, 15)
        tried = [np.array(c) for c in itertools.product(range(16), repeat=3) if (np.array(c) * weights).sum() <= 15]
        assert abs(value - max((c * values).sum() for c in tried)) < 1e-9 and abs((counts * values).sum() - value) < 1e-9
        assert (counts * weights).sum() <= 15
    patterns = K.cutting_stock(np.array([3, 5, 7]), np.array([40.0, 30.0, 20.0]), 16)
    assert all((p * [3, 5, 7]).sum() <= 16 for p, _ in patterns)
    made = sum(p * x for p, x in patterns)
    assert np.allclose(made, [40, 30, 20]) and sum(x for _, x in patterns) <= 27


@pytest.mark.parametrize("n", [0, 1, 7, 500])
def test_plan_places_every_piece_once(n):
    rng = np.random.default_rng(n)
    lengths = rng.integers(1, 2048, n)
    histogram = dict(zip(*(x.tolist() for x in np.unique(-(-lengths // 8) * 8, return_counts=True)), strict=True)) if n else {}
    plan = K.plan_rests(histogram, 2048, 8)
    assert plan.rows["count"].sum() == n
    for size, g in plan.rows.groupby("size"):
        g = g.sort_values("begin")
        assert (g["begin"].to_numpy() == np.cumsum(g["count"]) - g["count"]).all() and g["count"].sum() == histogram[size * 8]


def test_tokens_are_the_tokenizer_s():
    from tokenizers import Tokenizer

    texts = ["", "   ", "it's THEY'LL 12ab foo-bar!!", "<|endoftext|> x<|endoftext|>y <|startoftext|>", "\x1c z\xa0\u2003q é e\u0301 İ ß ﬁ 中文字 \x00 \x7f", "naïve's 'S don''t ''", "a" * 3000, "\u0301x y\u0301", "'s'S_'d "]
    full = Tokenizer.from_file(tokenizer_path())
    got = K.Tokens(tokenizer_path()).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [full.encode(t, add_special_tokens=False).ids for t in texts]


def test_pack_round_trip(spark, docs):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(8)
    texts = [None, "", "one", "long " * 5000, *[" ".join(rng.choice(["alpha", "beta", "xyzzyq", "é"], int(rng.integers(1, 900)))) for _ in range(60)]]
    table = docs([(i if i else None, t) for i, t in enumerate(texts)]).withColumn("size", F.lit("clash"))
    packed = K.pack(table.unionByName(table.filter("doc_id = 2")), tokenizer_path()).collect()
    full = Tokenizer.from_file(tokenizer_path())
    ids = {i or None: [*full.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    by_doc, by_sequence = {}, {}
    for r in packed:
        part = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        by_doc.setdefault(r["doc_id"], []).append(r["length"])
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert {d: sum(x) for d, x in by_doc.items()} == {d: len(x) * (2 if d == 2 else 1) for d, x in ids.items()}
    total = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
        total += at
    assert sorted(by_sequence) == list(range(len(by_sequence))) and total / (2048 * len(by_sequence)) > 0.9
    made = {r["sequence_id"]: r["ids"] for r in K.sequences(table, K.pack(table, tokenizer_path()), tokenizer_path()).collect()}
    assert sum(map(len, made.values())) == sum(map(len, ids.values()))
    assert K.pack(docs([]), tokenizer_path()).count() == 0


def test_ids_are_the_tokenizer_s_own():
    """Plain texts take a short way to their ids; it must agree with the tokenizer on every mixture of characters."""
    from tokenizers import Tokenizer

    path, draw = tokenizer_path(), random.Random(5)
    whole, quick = Tokenizer.from_file(path), K.Tokens(path)
    signs = [chr(c) for c in [*range(9, 14), *range(32, 127), *range(160, 256), 0x130, 0x3A3, 0x301, 0x4E2D]]
    texts = ["".join(draw.choice(signs if draw.random() < 0.5 else "abe'st dm,.Ééß1 ") for _ in range(draw.randint(0, 30))) for _ in range(3000)]
    texts += ["<|endoftext|>", "a<|startoftext|>b", "", "I'LL we're 'tis", "ªºµ ­"]
    for text, ids in zip(texts, quick.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_tokens_of_another_tokenizer(tmp_path):
    """A tokenizer that keeps case and knows whole words only encodes whole texts."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    other = Tokenizer(models.WordLevel({"Ab": 0, "ab": 1, "?": 2}, unk_token="?"))
    other.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    other.save(str(tmp_path / "other.json"))
    tokens = K.Tokens(str(tmp_path / "other.json"))
    assert not tokens.by_parts
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.encode(["Ab ab", "", "Ab1 ab"])] == [[0, 1], [], [2, 1]]


def test_tokens_forget_long_words(monkeypatch):
    tokens = K.Tokens(tokenizer_path())
    assert tokens.by_parts
    monkeypatch.setattr(K, "CACHED_CHARS", 1000)
    texts = ["x" * 900 + "y" * i + " word" for i in range(5)] + ["語" * 700 + str(i) for i in range(5)]
    for t in texts:
        assert tokens.encode([t]) == tokens._whole([t])
        assert sum(map(len, tokens.known)) + sum(map(len, tokens.parts)) <= 1000 + 2 * len(t)

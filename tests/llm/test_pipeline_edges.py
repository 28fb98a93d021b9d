import random

import pytest

import corpus_pipeline as P

SCHEMA = "text string, doc_id long, lang string, source string, n_chars long, row int, doc int, runs int, score int, lang_pred int, copy int, h int, mix_key int, gone int"
PIECES = {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}


def stages(spark, docs, folder):
    """The rows after every stage, each written and read as in run()."""
    out, docs = {}, docs
    for name, stage in P.STAGES:
        stage(spark, docs, "").write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out[name] = (docs.columns, docs.collect())
    return out


def test_empty_table(spark, tmp_path):
    for name, (columns, rows) in stages(spark, spark.createDataFrame([], SCHEMA), str(tmp_path)).items():
        assert rows == [] and set(columns) == (PIECES if name == "packing" else set(P.COLUMNS))


def test_nulls_ties_repeats_long_texts_and_clashing_columns(spark, tmp_path):
    rng = random.Random(8)
    parts = {"aa": ["ban", "tor", "lis", "mek"], "bb": ["zio", "que", "ara", "nu"]}
    words = lambda lang, n: " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(n))
    rows = [(i, words("aa" if i % 2 else "bb", 30), "aa" if i % 2 else "bb", "s") for i in range(1, 13)]
    long = words("aa", 60_000)
    rows += [(20, words("bb", 40), "bb", None)] * 2  # a repeated row, of no source
    rows += [(21, long, None, "s"), (22, long, "aa", "s")]  # a very long text and its copy
    rows += [(30, None, "aa", "s"), (31, "", "aa", "s"), (32, " \n\t", None, None), (33, "12 34", "bb", "s")]
    rows += [(None, words("aa", 35), "aa", "s"), (None, None, None, None)]
    docs = spark.createDataFrame([(t, i, y, s, None if t is None else len(t), *range(9)) for i, t, y, s in rows], SCHEMA)
    out = stages(spark, docs, str(tmp_path))
    ids = {name: sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in found) for name, (_, found) in out.items()}
    whole = [(False, i) for i in range(1, 13)]
    assert ids["language_id"] == [*whole, (False, 20), (False, 20), (False, 21), (False, 22), (True, 0)]
    assert {r["lang"] for r in out["language_id"][1]} == {"aa", "bb"}
    assert ids["line_dedup"] == [*whole, (False, 20), (False, 20), (False, 21), (True, 0)]  # the copy has no line left
    assert ids["near_dedup"] == ids["line_dedup"]
    assert next(r["text"] for r in out["near_dedup"][1] if r["doc_id"] == 21) == long
    for name, (columns, found) in out.items():
        assert set(columns) == (PIECES if name == "packing" else set(P.COLUMNS)), name
        if name != "packing":
            assert all(r["n_chars"] == len(r["text"]) for r in found)
    assert set(ids["mixing"]) <= set(ids["near_dedup"])
    mixed = [r["doc_id"] for r in out["mixing"][1]]
    assert mixed.count(20) % 2 == 0  # repeated rows draw the same count
    starts = [r["doc_id"] for r in out["packing"][1] if r["start"] == 0]
    assert sorted(starts, key=str) == sorted(mixed, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_dedup_of_tied_ids(spark, seed):
    """Texts that share an id are one document: it stays or goes as a whole."""
    rng = random.Random(seed)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    a, b, c = text(50), text(50), text(50)
    docs = spark.createDataFrame([(a, 1, "aa", "s", 1), (a, 2, "aa", "s", 1), (b, 2, "aa", "s", 1), (c, 3, "aa", "s", 1)], "text string, doc_id long, lang string, source string, n_chars long")
    kept = P.dedup_documents(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 3]

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
from test_near_dup import edited, naive
from test_quality_lines import naive_dedup

import corpus_pipeline as P
from veriframe.llm import language_id as L
from veriframe.llm import packing as K


def poisson_copies(rows):
    """Copies of (doc_id, source, size) rows by inverting the distribution step by step."""
    sizes = defaultdict(float)
    for _, s, n in rows:
        sizes[s] += n
    total, out = sum(sizes.values()), []
    for i, s, _ in rows:
        rate = total / len(sizes) / sizes[s]
        u = int(hashlib.md5(f"20|{i}".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-rate)
        below = p
        while below <= u:
            k += 1
            p *= rate / k
            below += p
        out.append(k)
    return out


def test_pipeline_against_plain_python(spark, tmp_path):
    rng = random.Random(6)
    parts = {"aa": ["ban", "tor", "lis", "mek"], "bb": ["zio", "que", "ara", "nu"]}
    text = lambda lang, n: [" ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(12)) for _ in range(n)]
    rows, passage = [], "\n".join(text("aa", 5))
    for i in range(40):
        lang = rng.choice(list(parts))
        lines = text(lang, rng.randint(1, 9))
        if lang == "aa" and i % 3 == 0:
            lines.insert(rng.randint(0, len(lines)), passage)
        rows.append((i, "\n".join(lines), lang, f"s{i % 3}"))
    long = text("bb", 8)
    rows += [(50 + i, edited(" ".join(long).split(), rng, i), "bb", "s0") for i in range(5)] + [(60, rows[3][1], rows[3][2], "s1"), (61, None, None, "s1"), (62, "12 34 !!", "aa", "s2"), (63, "", "aa", "s0")]
    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in P.run(spark, str(tmp_path)).collect())

    model = L.fit(docs.filter(~P.held_out()))
    names, scores = model.classify([t for _, t, *_ in rows])
    kept = [(i, t, s) for (i, t, _, s), n, x in zip(rows, names, scores, strict=True) if n != "und" and x >= P.LEAST_SCORE]
    assert {61, 62, 63}.isdisjoint(i for i, *_ in kept) and len(kept) >= 44
    lines = naive_dedup([(i, t) for i, t, _ in kept], 50)
    kept = [(i, lines[i, t], s) for i, t, s in kept if lines[i, t].strip()]
    groups = naive([(i, t) for i, t, _ in kept], 80)
    kept = [(i, t, s) for i, t, s in kept if groups[i][1] == i]
    assert {51, 60}.isdisjoint(i for i, *_ in kept)
    want = Counter()
    tokens = K.Tokens(P.tokenizer_path())
    import zlib

    for (i, t, _), n in zip(kept, poisson_copies([(i, s, len(t)) for i, t, s in kept]), strict=True):
        ids = np.append(np.frombuffer(tokens.encode([t])[0], "<u4"), 1).astype("<u4")
        for at in range(0, len(ids), 2048):
            piece = ids[at : at + 2048]
            want[i, at, len(piece), zlib.crc32(piece.tobytes())] += n
    assert got == Counter({k: n for k, n in want.items() if n})

"""Mining the phrases whose words occur together more than their parts account for, by language.

All phrases of 1 to max_n words are exploded into rows and counted by a hash aggregate per language; counts of the first
and last parts are joined, scores are exact decimals, phrases that a one-word extension explains go by an anti-join, and a
window ranks the rest.

A phrase is at most as frequent as the pairs of words in it. So pairs are counted first, as hashes: texts lie in blocks
of bounded size, each block tells its distinct pairs, a pair's counts are summed over all blocks, and those frequent enough go
back to the blocks that have them. A block then explodes only phrases whose pairs all came back. No block needs what is frequent
elsewhere, so nothing is broadcast and nothing grows but the number of blocks. Hashes that collide let a pair through too
many, never one too few: phrases themselves are counted as strings.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe.llm.common import cut, partitions

#: Longest phrase in words, least occurrences, percentage of them that an extension must have, and phrases of a language.
MAX_WORDS, LEAST, PERCENT, TOP = 4, 30, 80, 2000
SCALE = 2_000_000
#: Bytes of text that a block has, about.
BLOCK_BYTES = 8 << 20
#: Shares in which a language's phrases are ranked before the best of each are ranked together.
SHARES = 64

_TOKEN = re.compile(rb"[.,;:!?\x0A-\x0D]|[^\x20\x09.,;:!?\x0A-\x0D]+")
_ENDS = b".,;:!?\n\x0b\x0c\r"
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class _Words(dict):
    """Numbers of words from 1 on, as they are first asked for; 0 stands for the end of a piece."""

    def __init__(self):
        super().__init__({_ENDS[i : i + 1]: 0 for i in range(len(_ENDS))})
        self.known = [b""]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.known)
        self.known.append(word)
        return n


def _by_language(block: pa.Table):
    """For each language of a block: its name, the words' numbers in all its texts with 0 at each piece's end, and the words."""
    names = block.column("lang").to_pylist()
    texts = block.column("text").cast(pa.binary()).to_pylist()
    for lang in sorted(set(names)):
        words, ids = _Words(), [np.zeros(1, np.int64)]
        for name, text in zip(names, texts, strict=True):
            if name == lang and text:
                found = [words[w] for w in _TOKEN.findall(text.lower())]  # of bytes, this lowers A-Z alone
                found.append(0)
                ids.append(np.array(found, np.int64))
        yield lang, np.concatenate(ids), words.known


def _pairs(lang: str, ids: np.ndarray, known: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Where pairs of words stand side by side in a piece, and the pairs' hashes."""
    at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))
    x = hashes[ids[at]] * _MIX[0] + hashes[ids[at + 1]] + np.uint64(xxhash.xxh64_intdigest(lang))
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    x = (x ^ (x >> np.uint64(32))) * _MIX[2]
    return at, (x >> np.uint64(12)).astype(np.int64)


def _count_pairs(block: pa.Table) -> pa.Table:
    out = [np.unique(_pairs(*x)[1], return_counts=True) for x in _by_language(block)]
    pairs, counts = (np.concatenate([o[i] for o in out]) for i in (0, 1))
    return pa.table({"block": pa.array(np.full(len(pairs), block.column("block")[0].as_py(), np.int32)), "pair": pairs, "n": counts.astype(np.int64)})


def _count_phrases(max_n: int):
    def run(block: pa.Table, frequent: pa.Table) -> pa.Table:
        wanted = np.sort(frequent.column("pair").to_numpy())
        langs, phrases, sizes, counts = [], [], [], []

        def add(lang, found, size, n):
            langs.extend([lang] * len(found)), phrases.extend(found), sizes.extend([size] * len(found)), counts.extend(n.tolist())

        for lang, ids, known in _by_language(block) if len(block) else ():
            add(lang, [b""], 0, np.array([(ids > 0).sum()]))
            n = np.bincount(ids, minlength=len(known))
            add(lang, known[1:], 1, n[1:])
            at, pairs = _pairs(lang, ids, known)
            joined = np.zeros(len(ids) + max_n, bool)  # whether a word and the next make a frequent pair
            place = np.searchsorted(wanted, pairs)
            joined[at] = (place < len(wanted)) & (wanted[np.minimum(place, len(wanted) - 1)] == pairs) if len(wanted) else False
            # What phrase of the size before begins at each word, as a number; the next size adds a word to it.
            number, begins = ids, np.flatnonzero(ids > 0)
            texts = known
            for size in range(2, max_n + 1):
                begins = begins[joined[begins + size - 2]]
                if not len(begins):
                    break
                keys = number[begins] * len(known) + ids[begins + size - 1]
                distinct, inverse, n = np.unique(keys, return_inverse=True, return_counts=True)
                texts = [texts[k // len(known)] + b" " + known[k % len(known)] for k in distinct.tolist()]
                number = np.zeros(len(ids), np.int64)
                number[begins] = inverse
                add(lang, texts, size, n)
        return pa.table({"lang": pa.array(langs, pa.string()), "phrase": pa.array(phrases, pa.binary()).cast(pa.string()), "words": pa.array(sizes, pa.int32()), "n": pa.array(counts, pa.int64())})

    return run


def phrase_counts(docs: DataFrame, max_n: int = MAX_WORDS, least: int = LEAST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """lang, phrase, words, n: the phrases of up to max_n words with `least` occurrences or more, and by language all words' count.

    That count is the row with the empty phrase, of 0 words. docs has doc_id, lang and text. A text's block follows from its
    id and content, so a lost task finds the same one again.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(-(-size // block_bytes), partitions(spark))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block")
    placed = docs.select(block, "lang", "text")
    pairs = placed.groupBy("block").applyInArrow(_count_pairs, "block int, pair long, n long")
    total = F.sum("n").over(Window.partitionBy("pair"))
    frequent = pairs.withColumn("total", total).filter(F.col("total") >= least).select("block", "pair")
    each = placed.groupBy("block").cogroup(frequent.groupBy("block")).applyInArrow(_count_phrases(max_n), "lang string, phrase string, words int, n long")
    return each.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | (F.col("words") == 0))


def _exact(c: Column | int) -> Column:
    return (F.lit(c) if isinstance(c, int) else c).cast("decimal(19,0)")


def mine(docs: DataFrame, max_n: int = MAX_WORDS, least: int = LEAST, percent: int = PERCENT, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language by score, then a, then the phrase's bytes.

    Texts are lower-cased in A-Z and split at .,;:!? and line ends into pieces, and those at spaces and tabs into words. Of a
    phrase of 2 to max_n words, a is how often it stands within pieces, overlaps included; candidates have a >= least. Each cut
    into a first part with l occurrences and a rest with r scores floor(2000000 * a / (l + r)), exactly; the lowest score
    counts, of equal ones that of the earliest cut. Candidates go that stand in a candidate one word longer with at least
    `percent` of their occurrences (so they do if they stand in any longer one: what lies between is as frequent). n is the
    number of all words of the language.

    Null texts are empty, null languages are `und`; each row counts, repeated ones too; ties cannot occur, as phrases differ.
    Texts are read whole, however long. Other columns are not read; an empty table gives an empty result.
    """
    named = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts = cut(phrase_counts(named, max_n, least, block_bytes))
    candidates = counts.filter("words >= 2").withColumnRenamed("n", "a")
    parts = counts.filter(F.col("words").between(1, max_n - 1))
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": F.expr("substring_index(phrase, ' ', k)"), "rest": F.expr("substring_index(phrase, ' ', k - words)")})
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    score = F.call_function("div", _exact(SCALE) * _exact(F.col("a")), _exact(F.col("l") + F.col("r")))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b"))

    shorter = F.explode(F.array(*[F.expr(f"substring_index(phrase, ' ', {n})") for n in ("words - 1", "1 - words")]))
    inside = candidates.filter("words > 2").select("lang", shorter.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    explained = (best["lang"] == inside["lang"]) & (best["phrase"] == inside["phrase"]) & (100 * inside["longer"] >= percent * best["a"])
    own = best.join(inside, explained, "left_anti").select("lang", "phrase", "a", "b.l", "b.r", "b.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    first = own.withColumn("rank", F.row_number().over(Window.partitionBy("lang", share).orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    totals = counts.filter("words = 0").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

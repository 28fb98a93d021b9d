"""Language ID: a linear-chain conditional random field over words, for code-switched text too.

Every word of a text is labelled with a language. Its features are its affixes, its character bigrams and trigrams (with
marks at the word's ends) and the word itself as a lexicon entry; transitions between the labels of neighbouring words are
learned. Training maximises the likelihood on a bounded sample of labelled documents, cut into spans and spliced, so that
switches occur; prediction is by forward-backward over all words of the whole text.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriframe.llm.common import cut

#: Documents of each language that the model is fitted on, at most, and the longest such document, in characters.
SAMPLE_PER_LANGUAGE, SAMPLE_CHARS = 150, 20_000
#: Languages up to which the sample's limits, a row for each, are broadcast; beyond, they are joined by a shuffle.
BROADCAST_LANGUAGES = 10_000
#: Rows of the hashed feature table, passes over the sample, spans spliced together in training, and their words.
FEATURES, EPOCHS, RATE, DECAY = 1 << 17, 4, 0.3, 1e-4
SPAN = 24
#: Words of a block, within which messages run in parallel over all blocks.
BLOCK = 32
#: Characters and words that are labelled at once.
BATCH_CHARS = 3 << 20

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """The lower-cased runs of letters of a text."""
    return [w for w in _WORD.findall((text or "").lower()) if w.isalpha() or any(c.isalpha() for c in w)]


def _scramble(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(64 - 17)).astype(np.int64)


def features_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the feature table, word by word, and where each word's rows begin. Whole words, whatever their length."""
    joined = "\x02" + "\x02".join(words) + "\x02"
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    marks = np.flatnonzero(c == 2)
    begin, end = marks[:-1], marks[1:]  # the marks around each word
    size = end - begin - 1
    two = c[:-1] << np.uint64(21) | c[1:]
    three = two[:-1] << np.uint64(21) | c[2:]
    tri, bi = _scramble(three, 1), _scramble(two, 2)
    # A word has as many trigrams (and one more bigram than) letters with both marks around; they begin at its first mark.
    sums = np.zeros(len(c) + 1, np.uint64)
    power = np.cumprod(np.full(64, 0x100000001B3, np.uint64))
    place = np.arange(len(c)) - np.repeat(begin, np.diff(np.append(begin, len(c))))
    sums[1:] = np.cumsum((c + np.uint64(7)) * power[place % 64] * (place // 64 + 1).astype(np.uint64))
    lexicon = _scramble(sums[end] - sums[begin], 3)
    at = lambda i: c[np.clip(i, 0, len(c) - 1)]
    ends = [
        _scramble(two[begin + 1] << np.uint64(21) | at(begin + 3) * (size > 2), 4),  # first three letters
        _scramble(at(end - 3) * (size > 2) << np.uint64(42) | two[end - 2], 5),  # last three
        _scramble(at(end - 4) * (size > 3) ^ (at(end - 3) * (size > 2) << np.uint64(21)) ^ (two[end - 2] << np.uint64(22)), 6),
        _scramble(np.minimum(size, 12).astype(np.uint64), 7),
    ]
    per = 2 * size + 1 + 1 + len(ends)
    starts = np.cumsum(per) - per
    out = np.empty(int(per.sum()), np.int64)
    word = np.repeat(np.arange(len(words)), size)
    nth = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
    out[starts[word] + nth] = tri[begin[word] + nth]
    word2 = np.repeat(np.arange(len(words)), size + 1)
    nth2 = np.arange(len(word2)) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)
    out[starts[word2] + size[word2] + nth2] = bi[begin[word2] + nth2]
    for k, rows in enumerate([lexicon, *ends]):
        out[starts + 2 * size + 1 + k] = rows
    return out, starts


class Chains:
    """Many sequences of words, laid out in blocks so that messages are passed in a few hundred steps for all of them."""

    def __init__(self, sizes: np.ndarray):
        self.sizes = sizes
        blocks = -(-sizes // BLOCK)
        self.order = np.argsort(-blocks, kind="stable")
        self.blocks = blocks[self.order]
        self.first = np.cumsum(self.blocks) - self.blocks
        self.total = int(self.blocks.sum())
        begin = np.empty(len(sizes), np.int64)
        begin[self.order] = self.first * BLOCK
        self.place = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))

    def marginals(self, scores: np.ndarray, transition: np.ndarray, start: np.ndarray, pairs: bool = False):
        """P(label of each word), and, if asked for, the expected counts of transitions and of first labels."""
        n, labels = scores.shape
        e = np.ones((self.total * BLOCK, labels))
        e[self.place] = np.exp(scores - scores.max(axis=1, keepdims=True))
        real = np.zeros(self.total * BLOCK, bool)
        real[self.place] = True
        e, real = e.reshape(self.total, BLOCK, labels), real.reshape(self.total, BLOCK)
        t = np.exp(transition)
        head = np.zeros(self.total, bool)
        head[self.first] = True
        # Into the first word of a sequence leads no transition, but the scores of first labels from any state.
        into = np.where(head[:, None, None], np.exp(start)[None, None, :], t)
        # Over padding nothing changes, so a block's product is that of its words.
        product = np.broadcast_to(np.eye(labels), (self.total, labels, labels)).copy()
        for i in range(BLOCK):
            step = (product @ (t if i else into)) * e[:, i, None, :]
            step /= step.max(axis=(1, 2), keepdims=True)
            product = np.where(real[:, i, None, None], step, product)
        come = np.ones((self.total, labels))  # what reaches each block from before, and from behind
        go = np.ones((self.total, labels))
        for i in range(1, int(self.blocks.max(initial=0))):
            b = self.first[: np.searchsorted(-self.blocks, -i, side="left")] + i
            m = np.einsum("bi,bij->bj", come[b - 1], product[b - 1])
            come[b] = m / np.abs(m).max(axis=1, keepdims=True)
        for i in range(int(self.blocks.max(initial=0)) - 1, 0, -1):
            b = self.first[: np.searchsorted(-self.blocks, -i, side="left")] + i
            m = np.einsum("bij,bj->bi", product[b], go[b])
            go[b - 1] = m / m.max(axis=1, keepdims=True)
        alpha = np.empty((self.total, BLOCK, labels))
        m = come
        for i in range(BLOCK):
            step = (m @ t if i else np.einsum("bi,bij->bj", m, into)) * e[:, i]
            step /= step.sum(axis=1, keepdims=True)
            m = np.where(real[:, i, None], step, m)
            alpha[:, i] = m
        gamma = np.empty((self.total, BLOCK, labels))
        counts = np.zeros((labels, labels))
        m = go
        for i in reversed(range(BLOCK)):
            g = alpha[:, i] * m
            gamma[:, i] = g / g.sum(axis=1, keepdims=True)
            back = (e[:, i] * m) @ t.T
            if pairs:
                before = alpha[:, i - 1] if i else np.vstack([np.ones((1, labels)), alpha[:-1, -1]])
                x = before[:, :, None] * t * (e[:, i] * m)[:, None, :]
                inner = real[:, i] & ~head if i == 0 else real[:, i]
                x = x[inner]
                counts += (x / x.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            m = np.where(real[:, i, None], back / back.max(axis=1, keepdims=True), m)
        gamma = gamma.reshape(-1, labels)
        return gamma[self.place], counts, gamma[self.first * BLOCK].sum(axis=0)


class Model:
    """Languages, the feature table, transition scores and those of first labels."""

    def __init__(self, languages: list[str], table: np.ndarray, transition: np.ndarray, start: np.ndarray):
        self.languages, self.table, self.transition, self.start = languages, table, transition, start

    def label(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[list[str]]]:
        """For each text the probabilities of each language for each of its words, and the words."""
        words = [words_of(t) for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        known: dict[str, int] = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for ws in words for w in ws), np.int64, int(sizes.sum()))
        if not len(ids) or not self.languages:
            return [np.zeros((len(w), len(self.languages))) for w in words], words
        rows, starts = features_of(list(known))
        scores = np.add.reduceat(self.table[rows], starts, axis=0).astype(float)[ids]
        gamma, *_ = Chains(sizes[sizes > 0]).marginals(scores, self.transition, self.start)
        return np.split(gamma, np.cumsum(sizes)[:-1]), words

    def classify(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language that most words of each text have in expectation, and its share; `und` with 0 without letters."""
        marginals, words = self.label(texts)
        names, scores = [], np.zeros(len(texts))
        for i, (g, w) in enumerate(zip(marginals, words, strict=True)):
            if not w or not self.languages:
                names.append("und")
                continue
            share = g.mean(axis=0)
            names.append(self.languages[int(share.argmax())])
            scores[i] = min(1.0, float(share.max()))
        return names, scores


def train(texts: list[str], labels: list[str], seed: int = 9) -> Model:
    """A model of labelled texts, by adaptive gradient ascent on the likelihood of spliced sequences."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    spans: list[tuple[list[str], int]] = []
    for t, y in zip(texts, labels, strict=True):
        w = words_of(t)
        spans += [(w[i : i + SPAN], languages.index(y)) for i in range(0, len(w), SPAN)]
    table = np.zeros((FEATURES, len(languages)), np.float32)
    transition, start = np.zeros((len(languages),) * 2), np.zeros(len(languages))
    if not spans or len(languages) < 2:
        return Model(languages, table, transition, start)
    grown, grown_t = np.full_like(table, 1e-6), np.full_like(transition, 1e-6)
    known: dict[str, int] = {}
    ids = [np.array([known.setdefault(x, len(known)) for x in w]) for w, _ in spans]
    rows, starts = features_of(list(known))
    owner = np.repeat(np.arange(len(known)), np.diff(np.append(starts, len(rows))))
    for _ in range(EPOCHS):
        # Runs of up to eight spans in a row of the same text, then a switch to another.
        cut_at = np.flatnonzero(rng.random(len(spans)) < 1 / 8)
        pieces = np.split(np.arange(len(spans)), cut_at)
        order = np.concatenate([pieces[i] for i in rng.permutation(len(pieces))])
        for batch in np.array_split(order, max(1, len(order) // 600)):
            word = np.concatenate([ids[i] for i in batch])
            truth = np.concatenate([np.full(len(ids[i]), spans[i][1]) for i in batch])
            sizes = np.array([s.sum() for s in np.array_split(np.array([len(ids[i]) for i in batch]), max(1, len(batch) // 12))])
            used, at = np.unique(word, return_inverse=True)
            mine = np.isin(owner, used)
            score = np.zeros((len(known), len(languages)))
            np.add.at(score, owner[mine], table[rows[mine]])
            gamma, counts, first = Chains(sizes).marginals(score[word], transition, start, pairs=True)
            wrong = -gamma
            wrong[np.arange(len(word)), truth] += 1
            per_word = np.zeros((len(known), len(languages)))
            np.add.at(per_word, word, wrong)
            up = np.zeros((FEATURES, len(languages)), np.float32)
            np.add.at(up, rows[mine], per_word[owner[mine]])
            seen = np.unique(rows[mine])
            up = up[seen] / len(word) * 100 - DECAY * table[seen]
            grown[seen] += up**2
            table[seen] += RATE * up / np.sqrt(grown[seen])
            heads = np.cumsum(sizes) - sizes
            real = np.zeros_like(transition)
            inner = np.ones(len(word), bool)
            inner[heads] = False
            np.add.at(real, (truth[np.flatnonzero(inner) - 1], truth[inner]), 1)
            step = (real - counts) / len(word) * 100 - DECAY * transition
            grown_t += step**2
            transition += RATE * step / np.sqrt(grown_t)
            start += 0.02 * (np.bincount(truth[heads], minlength=len(languages)) - first) / len(heads)
    return Model(languages, table, transition, start)


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted({(y, t) for b in batches for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)})
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([t for _, t in rows], [y for y, _ in rows]))], pa.binary())], names=["model"])


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, id_col: str = "doc_id") -> Model:
    """A model of the labelled rows of docs (text, lang): of each language those with the least hashes, per_language at most.

    Null languages and texts, and texts of over SAMPLE_CHARS characters, are not learned from; ties go by text. The limit of
    each language is found on hashes alone and then filters the texts where they are read, so none moves but the sample. It
    is learned from in one task, as it is bounded, and the driver only sees the model.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    hashed = F.xxhash64(F.col(id_col), "text")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    limits = labelled.select("lang", hashed.alias("h")).withColumn("rank", rank).filter(F.col("rank") <= per_language).groupBy("lang").agg(F.max("h").alias("limit"))
    limits = cut(limits)
    if limits.count() <= BROADCAST_LANGUAGES:
        limits = F.broadcast(limits)
    picked = labelled.select("lang", "text", hashed.alias("h")).join(limits, "lang").filter("h <= limit").select("lang", "text")
    learned = picked.repartition(1).mapInArrow(_train, "model binary").first()
    return pickle.loads(learned["model"]) if learned else train([], [])  # no task runs without rows


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with lang_pred (a learned language, or `und`) and score (0 to 1), from the whole text alone.

    Null texts and texts without a letter are `und` with a score of 0, as all are if nothing was learned. Null ids and
    repeated rows are kept as they are; columns named lang_pred or score are replaced, and the text is left out unless
    keep_text; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES rows, whatever the corpus
    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    text_at = own.index(text_col)
    kept = [i for i, c in enumerate(own) if keep_text or c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at)
            at = 0
            while at < len(batch):
                part, size, begin = [], 0, at
                while at < len(batch) and size < BATCH_CHARS:
                    part.append(texts[at].as_py())
                    size += len(part[-1] or "")
                    at += 1
                names, scores = shared.value.classify(part)
                cut = batch.slice(begin, at - begin)
                yield pa.RecordBatch.from_arrays([*(cut.column(i) for i in kept), pa.array(names, pa.string()), pa.array(scores)], names=[*(own[i] for i in kept), "lang_pred", "score"])

    schema = T.StructType([*(docs.schema[own[i]] for i in kept), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(*own).mapInArrow(run, schema)

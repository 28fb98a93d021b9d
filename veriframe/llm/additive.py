"""Quality classifier: a generalised additive model with pairwise interactions, learned by cyclic boosting of shallow trees.

A text becomes a vector of statistics of its bytes, words and lines. Each statistic has bins and a lookup table, and so
have a few pairs of statistics; a score is the logistic function of an intercept and the entries that a text falls into, so
scoring is a vectorised addition of looked-up values. Learning goes round the statistics in turn: each gets a tree of a
few leaves over its bins, fitted to what all others leave open, and a small share of it is added to its table. Then the
pairs with the most left to explain are picked, and boosted in turn in the same way.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriframe.llm.common import cut

#: Documents of each label that the model is fitted on, in expectation, at most.
SAMPLE_PER_LABEL = 8_000
#: Bins of a statistic, and of each of a pair's; rounds over all statistics and over all pairs; pairs; share of a tree that is added.
BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 48, 12, 120, 60, 8, 0.15
LEAVES, SMOOTH, LEAST_WEIGHT = 3, 4.0, 8.0
#: Score from which a document is predicted to be of label 1.
THRESHOLD = 0.3
#: Characters that are turned into statistics at once.
BATCH_CHARS = 4 << 20

FEATURES = (
    "log_words", "log_chars", "symbols", "exclamations", "stops", "digits", "uppercase", "other_marks", "beyond_ascii", "controls",
    "white_space", "word_length", "word_length_spread", "short_words", "long_words", "capital_starts", "letter_ends", "distinct_words",
    "top_word", "repeated_windows", "repeated_lines", "words_a_line", "words_a_stop", "byte_entropy",
)

_BYTES = np.arange(256)
_IS = {
    "symbols": np.isin(_BYTES, list(b"#*$%&|<>")), "exclamations": np.isin(_BYTES, list(b"!?")), "stops": np.isin(_BYTES, list(b".,;:")), "digits": np.isin(_BYTES, list(b"0123456789")),
    "upper": (_BYTES >= 65) & (_BYTES <= 90), "lower": (_BYTES >= 97) & (_BYTES <= 122), "lead": _BYTES >= 0xC0, "inner": (_BYTES >= 0x80) & (_BYTES < 0xC0), "space": np.isin(_BYTES, list(b" \t\n\x0b\x0c\r")),
}
_IS["controls"] = ((_BYTES < 32) | (_BYTES == 127)) & ~_IS["space"]
_IS["other_marks"] = ~np.any([*_IS.values()], axis=0)
_LETTER = _IS["upper"] | _IS["lower"] | _IS["lead"] | _IS["inner"]
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, 6)], np.uint64)


def statistics_of(text: str | None) -> np.ndarray:
    """FEATURES of a whole text; all 0 without one. Shares are of characters, of letters, of words or of lines."""
    out = np.zeros(len(FEATURES))
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return out
    b = np.frombuffer(data, np.uint8)
    n = np.bincount(b, minlength=256)
    of = {k: int(n[m].sum()) for k, m in _IS.items()}
    chars = len(b) - of["inner"]
    words = data.split()  # at ASCII white space
    w = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    crcs = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    _, times = np.unique(crcs, return_counts=True)
    windows = sum(crcs[k : len(crcs) - 4 + k] * _POWERS[k] for k in range(5)) if len(crcs) >= 5 else crcs[:0]
    _, again = np.unique(windows, return_counts=True)
    lines = [x for x in data.split(b"\n") if x.strip()]
    space = np.concatenate([[True], _IS["space"][b], [True]])
    p = n[n > 0] / len(b)
    out[:] = (
        np.log1p(len(words)), np.log1p(chars), of["symbols"] / chars, of["exclamations"] / chars, of["stops"] / chars, of["digits"] / chars,
        of["upper"] / max(1, of["upper"] + of["lower"] + of["lead"]), of["other_marks"] / chars, of["lead"] / chars, of["controls"] / chars, of["space"] / chars,
        lengths.sum() / w, lengths.std() if len(words) else 0, (lengths <= 3).sum() / w, (lengths > 12).sum() / w,
        (space[:-2] & _IS["upper"][b]).sum() / w, (space[2:] & _LETTER[b]).sum() / w, len(times) / w, times.max(initial=0) / w,
        again[again > 1].sum() / max(1, len(windows)), 1 - len(set(lines)) / max(1, len(lines)), len(words) / max(1, len(lines)), len(words) / (1 + of["stops"]), -(p * np.log2(p)).sum(),
    )
    return out


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A value for each bin, by a tree of up to LEAVES leaves: the next cut is where squared gradients over weights gain most."""
    gs, hs = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    worth = lambda g, h: g * g / (h + SMOOTH)
    bounds = [0, len(g)]
    for _ in range(LEAVES - 1):
        best, where = 1e-9, None
        for a, z in zip(bounds, bounds[1:], strict=False):
            k = np.arange(a + 1, z)
            left, right = hs[k] - hs[a], hs[z] - hs[k]
            gain = worth(gs[k] - gs[a], left) + worth(gs[z] - gs[k], right) - worth(gs[z] - gs[a], hs[z] - hs[a])
            gain[(left < LEAST_WEIGHT) | (right < LEAST_WEIGHT)] = 0
            if len(k) and gain.max() > best:
                best, where = gain.max(), int(k[gain.argmax()])
        if where is None:
            break
        bounds = sorted([*bounds, where])
    out = np.empty(len(g))
    for a, z in zip(bounds, bounds[1:], strict=False):
        out[a:z] = (gs[z] - gs[a]) / (hs[z] - hs[a] + SMOOTH)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The gain, and a value for each cell, of the best cut of both statistics into four quarters."""
    sums = lambda x: np.pad(x.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
    gs, hs = sums(g), sums(h)
    quarters = lambda s: (s[1:-1, 1:-1], s[1:-1, -1:] - s[1:-1, 1:-1], s[-1:, 1:-1] - s[1:-1, 1:-1], s[-1, -1] - s[1:-1, -1:] - s[-1:, 1:-1] + s[1:-1, 1:-1])
    gq, hq = quarters(gs), quarters(hs)
    gain = sum(x * x / (y + SMOOTH) for x, y in zip(gq, hq, strict=True))
    a, b = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty_like(g)
    for part, x, y in zip((np.s_[: a + 1, : b + 1], np.s_[: a + 1, b + 1 :], np.s_[a + 1 :, : b + 1], np.s_[a + 1 :, b + 1 :]), gq, hq, strict=True):
        out[part] = x[a, b] / (y[a, b] + SMOOTH)
    return float(gain[a, b]), out


class Model:
    """An intercept, and for each statistic its bins' edges and table; for pairs, a table over both statistics' coarser bins."""

    def __init__(self, edges: list[np.ndarray]):
        self.edges, self.intercept = edges, 0.0
        self.tables = [np.zeros(len(e) + 1) for e in edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1)

    def coarse(self, bins: np.ndarray, f: int) -> np.ndarray:
        return bins[:, f] * PAIR_BINS // max(PAIR_BINS, len(self.tables[f]))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """P(label 1) of each row of statistics."""
        bins = self.bins(x)
        total = np.full(len(x), self.intercept)
        for f, t in enumerate(self.tables):
            total += t[bins[:, f]]
        for i, j, t in self.pairs:
            total += t[self.coarse(bins, i), self.coarse(bins, j)]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Model:
    """A model of rows of statistics, labels 0 and 1, and the weight of each row."""
    edges = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS)) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    model = Model(edges)
    share = float((weight * y).sum() / weight.sum()) if len(y) else 0.5
    model.intercept = float(np.log(np.clip(share, 1e-4, 1 - 1e-4) / (1 - np.clip(share, 1e-4, 1 - 1e-4))))
    if len(np.unique(y)) < 2:
        return model
    bins = model.bins(x)
    total = np.full(len(y), model.intercept)

    def open_() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return weight * (y - p), weight * p * (1 - p)

    for _ in range(ROUNDS):
        for f, t in enumerate(model.tables):
            g, h = open_()
            grown = RATE * _tree(np.bincount(bins[:, f], g, len(t)), np.bincount(bins[:, f], h, len(t)))
            t += grown
            total += grown[bins[:, f]]

    cells = [model.coarse(bins, f) for f in range(x.shape[1])]
    grid = lambda i, j, v: np.bincount(cells[i] * PAIR_BINS + cells[j], v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
    g, h = open_()
    gains = sorted((-_pair_tree(grid(i, j, g), grid(i, j, h))[0], i, j) for i in range(x.shape[1]) for j in range(i))
    model.pairs = [(i, j, np.zeros((PAIR_BINS, PAIR_BINS))) for _, i, j in gains[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, t in model.pairs:
            g, h = open_()
            grown = RATE * _pair_tree(grid(i, j, g), grid(i, j, h))[1]
            t += grown
            total += grown[cells[i], cells[j]]
    # Tables sum to nothing over what was learned from; the intercept takes what they had.
    for f, t in enumerate(model.tables):
        mean = float((weight * t[bins[:, f]]).sum() / weight.sum())
        t -= mean
        model.intercept += mean
    return model


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted(row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
    y, weight, x = (np.array([r[i] for r in rows], float) for i in range(3))
    model = train(x.reshape(len(rows), len(FEATURES)), y, weight)
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])


def _vectors(keep: list[str]):
    """Rows with the columns of keep, then the text's statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _parts(batch):
                s = [statistics_of(t).tolist() for t in texts]
                part = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(s, pa.list_(pa.float64()))], names=[*keep, "statistics"])

    return run


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str | None]]]:
    """The texts of a batch, its last column, in parts of about BATCH_CHARS characters, and where each part begins."""
    texts, at = batch.column(batch.num_columns - 1), 0
    while at < len(batch):
        part, size = [], 0
        while at + len(part) < len(batch) and size < BATCH_CHARS:
            part.append(texts[at + len(part)].as_py())
            size += len(part[-1] or "")
        yield at, part
        at += len(part)


def fit(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model of the texts of docs that labels (id, 0 or 1) marks: of each label about per_label ids by hash, if it has more.

    Rows of a label weigh as many as the label has ids for each that is learned from, so the labels' shares hold. Null ids and
    labels are not learned from, repeated labels count once, and of several texts of an id the one with the least statistics.
    The sample is picked by ids alone and texts are turned into statistics where they are read, so no text moves. It is
    learned from in one task, as it is bounded; the driver sees two counts and the model.
    """
    pool = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id IS NOT NULL AND label IN (0, 1)").distinct()
    sizes = {r["label"]: r["n"] for r in pool.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return train(np.zeros((0, len(FEATURES))), np.zeros(0), np.zeros(0))
    part = {y: min(1.0, per_label / n) for y, n in sizes.items()}
    share = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) / (1 << 30)
    limit = F.when(F.col("label") == 0, part.get(0, 1.0)).otherwise(part.get(1, 1.0))
    picked = cut(pool.filter(share < limit))
    if picked.count() <= 4 * per_label:
        picked = F.broadcast(picked)
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(picked, "id").select("id", "label", "text")
    vectors = found.mapInArrow(_vectors(["id", "label"]), T.StructType([T.StructField("id", docs.schema[id_col].dataType), *T.StructType.fromDDL("label int, statistics array<double>").fields]))
    one = vectors.groupBy("id", "label").agg(F.min("statistics").alias("statistics"))
    weight = F.when(F.col("label") == 0, 1 / part.get(0, 1.0)).otherwise(1 / part.get(1, 1.0))
    learned = one.select("label", weight.alias("weight"), "statistics").repartition(1).mapInArrow(_train, "model binary").first()
    return pickle.loads(learned["model"]) if learned else train(np.zeros((0, len(FEATURES))), np.zeros(0), np.zeros(0))


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD, keep_text: bool = True) -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier) and predicted (1 from `threshold` on), from the whole text alone.

    Null and empty texts have all statistics 0 and are scored by them; if nothing was learned, all scores are 0.5. Null ids and
    repeated rows stay as they are; columns named score or predicted are replaced; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some thousand numbers, whatever the corpus
    own = [c for c in docs.columns if c not in ("score", "predicted", text_col)]
    kept = own + [text_col] * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _parts(batch):
                s = shared.value.scores(np.stack([statistics_of(t) for t in texts]))
                part = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*kept, "score", "predicted"])

    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    out = docs.select(*own, text_col).mapInArrow(run, schema)
    return out.select(*[c for c in docs.columns if c in kept and c not in ("score", "predicted")], "score", "predicted")

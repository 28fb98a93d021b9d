"""Packing documents into training sequences by cutting-stock column generation.

Documents become token ids and are cut into pieces of at most a sequence's length; a document's full pieces fill sequences
of their own, and its rest is packed. The histogram of rests is a cutting-stock problem: a linear program over patterns
(multisets of lengths that fit one sequence), whose columns are priced by a knapsack over the dual values. Rounded down,
the patterns are dealt out; what is left over, a few pieces for each pattern at most, is packed best fit first. The program
sees lengths only, at most one count for each, however large the corpus. Pieces are ranked within their length, and each
finds its pattern, repetition and place from its rank alone.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriframe.llm.common import cut, partitions

LENGTH, END_ID = 2048, 1
#: Lengths are rounded up to a multiple of this for the linear program.
STEP = 8
#: The program ends when its value is within this factor of a lower bound: the tokens over the sequence's length, or the
#: value over what the best pattern is worth.
CLOSE = 1.001
#: Words that a task keeps the ids of, and the characters that they may have in all.
CACHED_WORDS = 400_000
CACHED_CHARS = 32_000_000

_CHUNK = re.compile(r"[^ \t\n\r\x0b\x0c]+")


class _PartIds(dict):
    """Ids of parts by the model alone, found when first asked for. The model reads each byte as a character of its own."""

    def __init__(self, model):
        super().__init__()
        self.model = model

    def __missing__(self, part: str) -> bytes:
        seen = part if part.isascii() else "".join([_BYTE_CHARS[b] for b in part.encode()])
        self[part] = ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(seen)])
        return ids


class Tokens:
    """Ids of texts by a tokenizer file, as little-endian 32-bit bytes; each distinct chunk or part of a text is encoded once.

    Chunks end at ASCII white space, which the tokenizer is taken to drop, with no token reaching over it, and plain texts
    are cut by `_PARTS`. A tokenizer that gives other ids on a probe of such texts encodes every text whole instead.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.parts, self.chars = _PartIds(self.tokenizer.model), 0
        try:
            self.by_parts = [self._whole([p])[0] for p in _PROBES] == self._by_parts(_PROBES)
        except Exception:  # a model that can't read a part by itself
            self.by_parts = False

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _plain(self, text: str) -> bytes:
        """Ids of a text that is plain (see _is_plain): its lower-cased parts, encoded one by one by the model."""
        ids = self.parts
        return b"".join([ids[p] for p in _PARTS.findall(text.lower())])

    def _chunked(self, texts: list[str]) -> list[bytes]:
        """Ids of any texts, chunk by chunk."""
        chunks = [_CHUNK.findall(t) for t in texts]
        other = []
        for c in {c for cs in chunks for c in cs}.difference(self.known):
            if _is_plain(c):
                self.known[c] = self._plain(c)
            else:
                other.append(c)
        for at in range(0, len(other), 10_000):
            part = other[at : at + 10_000]
            found = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids, word = np.array(found.ids, "<u4"), np.array([-1 if w is None else w for w in found.word_ids])
            if (word < 0).any():  # a special token belongs to no word
                for c in part:
                    self.known[c] = np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, "<u4").tobytes()
                continue
            cuts = (4 * np.searchsorted(word, np.arange(len(part) + 1))).tolist()
            data = ids.tobytes()
            for i, c in enumerate(part):
                self.known[c] = data[cuts[i] : cuts[i + 1]]
        known = self.known
        return [b"".join([known[c] for c in cs]) for cs in chunks]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_parts:
            return self._whole(texts)
        # A text adds at most its own length to each cache.
        self.chars += 2 * sum(map(len, texts))
        if self.chars > CACHED_CHARS:
            self.chars = sum(map(len, self.known)) + sum(map(len, self.parts))
        if self.chars > CACHED_CHARS:
            self.known.clear()
            self.parts.clear()
            self.chars = 0
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        if len(self.parts) > CACHED_WORDS:
            self.parts.clear()
        return self._by_parts(texts)

    def _by_parts(self, texts: list[str]) -> list[bytes]:
        plain = [_is_plain(t) for t in texts]
        rest = iter(self._chunked([t for t, easy in zip(texts, plain, strict=True) if not easy]))
        return [self._plain(t) if easy else next(rest) for t, easy in zip(texts, plain, strict=True)]


def _is_plain(text: str) -> bool:
    """Whether a text holds nothing but printable ASCII, ASCII white space and common Latin-1 characters, and no special token.

    Of these, no character changes by normalisation, and each is lower-cased by itself.
    """
    return "<|" not in text and not _UNUSUAL.search(text)


#: How the tokenizer cuts lower-cased text of such characters into the parts that its model encodes.
_PARTS = re.compile(r"[a-zß-öø-ÿ]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9²³¹¼½¾]|[^\sa-zß-öø-ÿ0-9²³¹¼½¾]+")
_UNUSUAL = re.compile(r"[^\t-\r -~¡-©«-´¶-¹»-ÿ]")
#: Texts with all plain characters alone and in a row, words in both cases, contractions, numbers, and texts that are not plain.
_PLAIN = [c for c in map(chr, range(256)) if not _UNUSUAL.search(c)]
_PROBES = [
    " ".join(_PLAIN),
    "".join(_PLAIN),
    "Ab" + "ab Ab".join(_PLAIN),
    "It's WE'LL they'd  don't\t\tÉCOLE naïve\r\n1984 3.14 a1b2 -- ==(x)!? ' s 're\x0b_under_score_ HTTP://A.org/?q=1",
    " \n",
    "mixed 日本語 text, ﬁne Ⅷ e\u0301 İstanbul \u00a0no-break \u3000 wide ½ªº",
]
#: The character that stands for each byte: itself if it is visible Latin-1, and else one from 256 on, in order.
_VISIBLE = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_BYTE_CHARS = dict(zip([*_VISIBLE, *(b for b in range(256) if b not in set(_VISIBLE))], [chr(b) for b in _VISIBLE] + [chr(256 + i) for i in range(256 - len(_VISIBLE))], strict=True))


def _cut_pieces(path: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(path)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                ids, starts, sizes, crcs, totals = [], [], [], [], []
                for i, data in zip(part.column(0).to_pylist(), tokens.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    data += end
                    n = len(data) // 4
                    for start in range(0, n, length):
                        piece = data[4 * start : 4 * (start + length)]
                        ids.append(i), starts.append(start), sizes.append(len(piece) // 4), crcs.append(zlib.crc32(piece)), totals.append(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), *(pa.array(x, pa.int64()) for x in (starts, sizes, crcs, totals))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                )

    return run


def _knapsack(values: np.ndarray, weights: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of items within the capacity, by dynamic programming: its value, and how often each."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(weights, kind="stable")
    w, v = weights[order], values[order]
    fits = np.searchsorted(w, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if fits[c]:
            gains = best[c - w[: fits[c]]] + v[: fits[c]]
            i = int(gains.argmax())
            if gains[i] > best[c] + 1e-12:
                best[c], choice[c] = gains[i], i
    counts, c = np.zeros(len(values), np.int64), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            counts[order[choice[c]]] += 1
            c -= w[choice[c]]
    return float(best[capacity]), counts


def _inverse(basis: np.ndarray) -> np.ndarray:
    """The inverse by row operations with pivots: plain array arithmetic, as a threaded library call may not return in the driver."""
    m = len(basis)
    a = np.hstack([basis.astype(float), np.eye(m)])
    for i in range(m):
        p = i + int(np.abs(a[i:, i]).argmax())
        a[[i, p]] = a[[p, i]]
        a[i] /= a[i, i]
        factors = a[:, i].copy()
        factors[i] = 0
        a -= factors[:, None] * a[i]
    return a[:, m:]


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often each is used in the optimum of the linear program, by column generation.

    The basis starts with one pattern for each size (as many as fit). Each round prices all patterns at once by a
    knapsack over the dual values and brings the best into the basis, until the value is CLOSE to a lower bound.
    """
    m = len(sizes)
    fit = capacity // sizes
    patterns = [np.eye(1, m, i, dtype=np.int64)[0] * fit[i] for i in range(m)]
    inverse, x, bound = np.diag(1.0 / fit), demand / fit, float((sizes * demand).sum()) / capacity
    for rounds in range(40 * m + 100):
        duals = inverse.sum(axis=0)
        value, column = _knapsack(duals, sizes, capacity)
        bound = max(bound, x.sum() / value)
        if value <= 1 + 1e-7 or x.sum() <= CLOSE * bound:
            break
        used = np.flatnonzero(column)
        d = (inverse[:, used] * column[used]).sum(axis=1)
        rising = d > 1e-9
        if not rising.any():
            break
        ratios = np.where(rising, x / np.where(rising, d, 1), np.inf)
        out = int(ratios.argmin())
        x = x - ratios[out] * d
        x[out] = ratios[out]
        x = np.maximum(x, 0)
        row = inverse[out] / d[out]
        inverse -= d[:, None] * row
        inverse[out] = row
        patterns[out] = column
        if rounds % 200 == 199:  # rounding errors do not add up
            inverse = _inverse(np.array(patterns).T)
            x = np.maximum((inverse * demand).sum(axis=1), 0)
    return list(zip(patterns, x, strict=True))


@dataclass
class Plan:
    """Where the pieces of each length go: for the pieces of a length, from rank `begin` on, `per` to each sequence."""

    rows: pd.DataFrame
    sequences: int


def plan_rests(histogram: dict[int, int], length: int, step: int) -> Plan:
    """Slots for all pieces of a histogram of lengths below a sequence's.

    Every slot is (length, begin, count, per, sequence, place): the pieces of this length with ranks begin to begin +
    count - 1 lie, `per` to a sequence, in the sequences from `sequence` on, at the places from `place` on.
    """
    up = lambda n: -(-n // step)
    capacity = length // step
    demand: dict[int, int] = {}
    for n, count in histogram.items():
        demand[up(n)] = demand.get(up(n), 0) + count
    sizes = np.array(sorted(demand))
    wanted = np.array([demand[s] for s in sizes])
    shapes: list[tuple[list[tuple[int, int]], int]] = []  # (class, how many) of a sequence, and how many such sequences
    left = wanted.copy()
    if len(sizes):
        for pattern, times in cutting_stock(sizes, wanted.astype(float), capacity):
            times = int(min([times + 1e-6, *(left[i] // pattern[i] for i in np.flatnonzero(pattern))]))
            if times > 0 and pattern.any():
                shapes.append(([(int(i), int(pattern[i])) for i in np.flatnonzero(pattern)], times))
                left -= pattern * times
        bins: dict[int, list[dict[int, int]]] = {}  # by room left
        for i in reversed(range(len(sizes))):
            for _ in range(int(left[i])):
                room = next((r for r in range(int(sizes[i]), capacity) if bins.get(r)), None)
                held = bins[room].pop() if room is not None else {}
                held[i] = held.get(i, 0) + 1
                bins.setdefault((capacity if room is None else room) - int(sizes[i]), []).append(held)
        shapes += [(sorted(b.items()), 1) for held in bins.values() for b in held]
    # Ranks within a class run through its lengths in turn.
    rows, sequence, used = [], 0, np.zeros(len(sizes), np.int64)
    for items, times in shapes:
        place = 0
        for i, per in items:
            rows.append((int(sizes[i]), int(used[i]), per * times, per, sequence, place))
            used[i] += per * times
            place += per
        sequence += times
    return Plan(pd.DataFrame(rows, columns=["size", "begin", "count", "per", "sequence", "place"]), sequence)


def _deal(plan: pd.DataFrame):
    by_size = {int(k): g.sort_values("begin") for k, g in plan.groupby("size")}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sequence, place = np.empty(len(f), np.int64), np.empty(len(f), np.int64)
            rank = f["rank"].to_numpy()
            for size, at in f.groupby("size").indices.items():
                slots = by_size[int(size)]
                i = np.searchsorted(slots["begin"].to_numpy(), rank[at], side="right") - 1
                within = rank[at] - slots["begin"].to_numpy()[i]
                per = slots["per"].to_numpy()[i]
                sequence[at] = slots["sequence"].to_numpy()[i] + within // per
                place[at] = slots["place"].to_numpy()[i] + within % per
            yield f.drop(columns=["size", "rank"]).assign(sequence_id=sequence, place=place)

    return run


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, step: int = STEP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece of each row of docs.

    A document's ids are those of its text (null: none) and END_ID. Pieces start at multiples of `length`; each id lies
    in one piece. Pieces of a sequence lie side by side from offset 0 in it. Sequence ids are 0, 1, ... without gaps:
    those of rests first, then those that one piece fills. Repeated rows are packed as often as they come, null ids as any
    others. Other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = cut(named.mapInArrow(_cut_pieces(tokenizer_path, length), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"))

    # Ranks within a size class (full pieces are one): by salt, with the counts of smaller salts added.
    size = F.when(F.col("length") == length, F.lit(0)).otherwise(F.ceil(F.col("length") / step)).cast("int")
    salts = 4 * partitions(spark)
    salted = pieces.withColumn("size", size).withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = cut(salted.groupBy("size", "salt").agg(F.count(F.lit(1)).alias("n")))  # at most length / step x salts rows
    before = F.sum("n").over(Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.select("size", "salt", F.coalesce(before, F.lit(0)).alias("shift"))
    order = Window.partitionBy("size", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = salted.join(shifts, ["size", "salt"]).withColumn("rank", F.row_number().over(order) - 1 + F.col("shift")).drop("salt", "shift")

    histogram = {r["size"] * step: r["n"] for r in counts.filter("size > 0").groupBy("size").agg(F.sum("n").alias("n")).collect()}
    plan = plan_rests(histogram, length, step)
    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, place long"
    rests = ranked.filter("size > 0").mapInPandas(_deal(plan.rows), kind)
    inside = Window.partitionBy("sequence_id").orderBy("place")
    offset = F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    packed = rests.withColumn("offset", offset).drop("place")
    full = ranked.filter("size = 0").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + plan.sequences).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)


def sequences(docs: DataFrame, packed: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """sequence_id, ids: the token ids of every packed sequence, without padding. docs must have one row for each id."""

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(tokenizer_path)
        for batch in batches:
            data = tokens.encode([t or "" for t in batch.column(1).to_pylist()])
            arrays = [np.append(np.frombuffer(x, "<u4"), END_ID).astype(np.int32) for x in data]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(arrays, pa.list_(pa.int32()))], names=["doc_id", "all"])

    encoded = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(ids, "doc_id long, all array<int>")
    piece = F.slice("all", (F.col("start") + 1).cast("int"), F.col("length").cast("int"))
    placed = packed.join(encoded, packed["doc_id"].eqNullSafe(encoded["doc_id"])).select("sequence_id", "offset", piece.alias("ids"))
    return placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"))

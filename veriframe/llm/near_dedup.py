"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full shingle sets and union-find grouping.

Copies with the same set of shingles are one class from the start. Signatures of classes are cut into bands; classes that
share a band's values meet in a bucket. A bucket first proposes its smallest class to all others, which links large groups
of near copies with as many pairs as members; the links are confirmed on the full sets and the groups joined. Texts of buckets
that stay apart meet again if they share one of their rarest shingles, as all links do but a shared passage does not.
Those that meet are compared with a few leaders, near the group's middle; members still apart can only be linked if they
differ from the middle in the same shingles, and every pair that may do so is confirmed or refuted (see differing). So no link
between different texts of one bucket is lost however large the bucket. Groups grow by repeated exchange of smallest members (large star, small star).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriframe.llm.common import cut, partitions

SHINGLE = 5
#: Slots of a signature. A prime, so that multiplication by anything but 0 permutes the slots.
SLOTS = 127
#: Chance, at most, that two texts just at the threshold share no bucket.
MISS = 1e-6
#: Members of a group that all others are compared with.
LEADERS = 6
#: Bytes of text that are shingled at once.
BLOCK = 4 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def shingle_hashes(text: str | None) -> np.ndarray:
    """The distinct shingles of one text as sorted 64-bit hashes: five words each, or all words if there are fewer.

    A-Z are lower-cased and words are cut at ASCII white space. The hash is a polynomial in the bytes of the words
    joined by single blanks, so that those of all shingles come from one running sum.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    data = np.frombuffer(b" ".join(words), np.uint8)
    n = len(data)
    if len(_TABLES[0]) < n + 2:
        _TABLES[0], _TABLES[1] = _powers(_BASE, 2 * n + 2), _powers(_INVERSE, 2 * n + 2)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _TABLES[0][:n], out=sums[1:])
    ends = np.append(np.flatnonzero(data == 32), n)
    starts = np.append(0, ends[:-1] + 1)
    k = min(SHINGLE, len(words)) - 1
    starts, ends = starts[: len(starts) - k], ends[k:]
    value = (sums[ends] - sums[starts]) * _TABLES[1][starts]
    return np.unique(mix(value ^ ((ends - starts).astype(np.uint64) << np.uint64(40))))


_TABLES = [_powers(_BASE, 1 << 16), _powers(_INVERSE, 1 << 16)]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash signatures, one row of SLOTS for each set; of empty sets, all ones.

    Each element brings a permutation of the slots (an affine one, from its hash) and numbers r_0, r_1, ... in [0, 1). At
    the slot that its permutation has at rank j it offers j + r_j, and a slot keeps the least offer. Ranks are taken one
    at a time for all elements; a set is done when every slot holds less than the next rank.
    """
    out = np.full((len(sets), SLOTS), np.iinfo(np.uint64).max, np.uint64)
    sizes = np.array([len(s) for s in sets])
    if not sizes.sum():
        return out
    elements, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    first, stride = mix(elements, 1) % np.uint64(SLOTS), mix(elements, 2) % np.uint64(SLOTS - 1) + np.uint64(1)
    flat = out.reshape(-1)
    for j in range(SLOTS):
        slot = owner * SLOTS + ((first + np.uint64(j) * stride) % np.uint64(SLOTS)).astype(np.int64)
        np.minimum.at(flat, slot, (np.uint64(j) << np.uint64(32)) | (mix(elements, 3 + j) >> np.uint64(32)))
        open_sets = (out.max(axis=1) >= np.uint64(j + 1) << np.uint64(32)) & (sizes > 0)
        if not open_sets.any():
            break
        going = open_sets[owner]
        if not going.all():
            elements, owner, first, stride = elements[going], owner[going], first[going], stride[going]
    return out


def rows_per_band(threshold: float) -> int:
    """The most rows a band may have for two texts at the threshold to share no band with a chance of at most MISS."""
    return max([1, *(r for r in range(1, 20) if (1 - threshold**r) ** (SLOTS // r) <= MISS)])


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    bands = SLOTS // rows
    keys = np.zeros((len(signature), bands), np.uint64)
    for i in range(rows):
        keys = mix(keys ^ signature[:, i * bands : (i + 1) * bands], 1000 + i)
    return mix(keys + np.arange(bands, dtype=np.uint64)[None, :], 999)


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sketch(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at = 0
            while at < len(batch):
                sets, size, begin = [], 0, at
                while at < len(batch) and size < BLOCK:
                    text = texts[at].as_py()
                    sets.append(shingle_hashes(text))
                    size += len(text or "")
                    at += 1
                keys = band_keys(signatures(sets), rows)
                counts = np.array([len(s) for s in sets])
                keys = [k if n else k[:0] for k, n in zip(keys.view(np.int64), counts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(begin, at - begin),
                        pa.array(counts, pa.int64()),
                        pa.array([_digest(s) for s in sets], pa.binary()),
                        pa.array(keys, pa.list_(pa.int64())),
                    ],
                    names=["id", "n_shingles", "digest", "bands"],
                )

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id (the class) and shingles, of the rows (class, digest, text) whose text is of their class."""
    for batch in batches:
        for at in range(0, len(batch), 512):
            part = batch.slice(at, 512)
            sets = [shingle_hashes(t.as_py()) for t in part.column(2)]
            own = np.array([_digest(s) == d.as_py() for s, d in zip(sets, part.column(1), strict=True)], bool)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["id", "shingles"]).filter(pa.array(own))


def components(links: DataFrame) -> DataFrame:
    """node, component: the smallest node that each node of links (a, b) can reach; nodes without links have no row.

    Every round hangs each node's larger neighbours onto its smallest one, then each node and its smaller neighbours
    onto the smallest of these, until nothing changes. Hubs are joined to, not collected. Shuffle partitions are sized for
    texts; edges are two numbers each, so an eighth as many tasks hold them.
    """
    parts = partitions(links.sparkSession)
    few = min(parts, max(8, parts // 8))
    way = lambda a, b: F.struct(F.col(a).alias("u"), F.col(b).alias("v"))
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct().coalesce(few))
    while True:
        both = edges.select(F.inline(F.array(way("u", "v"), way("v", "u"))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").coalesce(few)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v")).filter("u > v")
        edges = cut(small.coalesce(few).distinct().coalesce(few))
        # Done when no node has two parents and no parent has one of its own.
        roles = F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")), F.struct(F.col("v").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
        counts = edges.select(F.inline(roles)).groupBy("node").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
        if counts.filter("child + parent > 1 and child > 0").isEmpty():
            break
    return cut(edges.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("component")), F.struct(F.col("v").alias("node"), F.col("v").alias("component"))))).distinct())


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("i"), (F.size("sa") + F.size("sb")).alias("n"))
    return met.filter(F.col("i") * 100 >= percent * (F.col("n") - F.col("i"))).select("a", "b")


def rarest(sets: DataFrame, percent: int) -> DataFrame:
    """key, id, n: each set's rarest shingles, as many as two sets at the threshold cannot both do without, and its size.

    Sets with 100 * |intersection| >= percent * |union| share percent / 100 of either at least, so they share one of the
    |set| - ceil(percent / 100 * |set|) + 1 that come first in any order common to all sets. Rare shingles come first, so a
    passage that many texts share brings none of them together. Shingles of one set only are left out at the end.
    """
    rows = sets.select("id", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("key"))
    known = rows.groupBy("key").agg(F.count(F.lit(1)).alias("f"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("f", "key"))
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    return rows.join(known, "key").withColumn("rank", rank).filter((F.col("rank") <= first) & (F.col("f") > 1)).select("key", "id", "n")


def spread(tops: DataFrame, sets: DataFrame) -> DataFrame:
    """top, id, n, m, delta: how the set of each member of a group (id, top) differs from the group's middle, of size m.

    The middle holds what more than half of the members have. It is no larger than twice the mean set. What the whole group
    shares is in no delta, and neither are the edits of any one member in those of the others.
    """
    held = cut(sets.join(tops, "id").select("id", "top", "shingles"))
    sizes = held.groupBy("top").agg(F.count(F.lit(1)).alias("c"))
    counts = held.select("top", F.explode("shingles").alias("key")).groupBy("top", "key").agg(F.count(F.lit(1)).alias("f"))
    middles = counts.join(sizes, "top").filter(2 * F.col("f") > F.col("c")).groupBy("top").agg(F.collect_list("key").alias("middle"))
    middle = F.coalesce("middle", F.array().cast("array<bigint>"))
    delta = F.concat(F.array_except("shingles", middle), F.array_except(middle, "shingles"))
    return cut(held.join(middles, "top", "left").select("top", "id", F.size("shingles").alias("n"), F.size(middle).alias("m"), delta.alias("delta")))


def leading(apart: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each group's LEADERS members nearest to its middle, by |delta| - r |set|, with all other members."""
    r = (100 - percent) / (100 + percent)
    near = F.row_number().over(Window.partitionBy("top").orderBy(F.size("delta") - r * F.col("n"), "id"))
    leaders = apart.withColumn("rank", near).filter(F.col("rank") <= LEADERS).select("top", F.col("id").alias("leader"))
    return apart.select("top", "id").join(leaders, "top").filter("id != leader").select(F.least("leader", "id").alias("a"), F.greatest("leader", "id").alias("b")).distinct()


def differing(apart: DataFrame, joined: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one group's members that may be linked and lie in different components.

    apart is what spread gives; every member must have been compared with the first of the leading ones, and joined must
    hold those links. Let D be a set's delta and r = (100 - percent) / (100 + percent). Sets x and y are linked if
    |Dx| + |Dy| - 2 |Dx & Dy| <= r (|x| + |y|). If |Dx| + |Dy| alone is as small as that, it is for x and for y with the first
    leader in the other's place, too, as no member has a smaller |D| - r |set|: both are linked with that leader and lie in
    one component. All other linked pairs share elements of D, at least (|Dx| + |Dy| - r (|x| + |y|)) / 2 of them, and so
    one of the first in an order common to all: those that one component only has, then the rarest. A text's own edits come
    first there, so members meet only where they share edits. The side of larger D probes: with e = |D| - r (|x| + |middle|)
    it shares e / (1 + r) elements at least; the other side shares |D| - r (|D| + |y| + |middle|) / 2 at least, as the
    partner's D is no smaller. One element is the least in either case.
    """
    r = (100 - percent) / (100 + percent)
    placed = apart.join(joined.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    rows = cut(placed.select("top", "id", "component", "n", "m", F.size("delta").alias("d"), F.explode("delta").alias("key")))
    known = rows.groupBy("top", "key").agg(F.count(F.lit(1)).alias("f"), (F.min("component") < F.max("component")).alias("met"))
    ranked = rows.join(known, ["top", "key"]).withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("met", "f", "key")))
    # A little slack keeps rounding from losing a pair.
    probes = F.greatest(F.lit(1), F.ceil((F.col("d") - r * (F.col("n") + F.col("m"))) / (1 + r) - 1e-6))
    listed = F.greatest(F.lit(1), F.ceil(F.col("d") - r * (F.col("d") + F.col("n") + F.col("m")) / 2 - 1e-6))
    ranked = cut(ranked.filter("met").withColumns({"probes": F.col("rank") <= F.col("d") - probes + 1, "listed": F.col("rank") <= F.col("d") - listed + 1}).filter("probes or listed"))
    x = ranked.filter("probes").select("top", "key", F.col("id").alias("x"), "n", "d", "rank", "component")
    y = ranked.filter("listed").select("top", "key", F.col("id").alias("y"), F.col("n").alias("n2"), F.col("d").alias("d2"), F.col("rank").alias("rank2"), F.col("component").alias("component2"))
    larger = (F.col("d2") < F.col("d")) | ((F.col("d2") == F.col("d")) & (F.col("y") < F.col("x")))
    # Where two first meet, they can share this element and what comes behind it in both.
    most = 1 + F.least(F.col("d") - F.col("rank"), F.col("d2") - F.col("rank2"))
    enough = 2 * most + 1e-6 >= F.col("d") + F.col("d2") - r * (F.col("n") + F.col("n2"))
    met = x.join(y, ["top", "key"]).filter((F.col("component") != F.col("component2")) & larger & enough)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _apart(members: DataFrame, joined: DataFrame) -> tuple[DataFrame, bool]:
    """The members of groups (of one key) that hold several components, and whether there are any."""
    place = members.join(joined.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("component"))
    open_keys = place.groupBy("key").agg(F.min("component").alias("one"), F.max("component").alias("other")).filter("one < other").select("key")
    place = cut(place.join(open_keys, "key"))
    return place, not place.isEmpty()


def classes_of(real: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classes (id, least, n, bands, digest) of rows with the same set, and which rows (doc) are of which class (id).

    A class is named by a number that no other has; `least` is its smallest document id.
    """
    grouped = real.groupBy("digest").agg(F.min("id").alias("least"), F.max("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = cut(grouped.select(F.monotonically_increasing_id().alias("id"), "least", "n", "bands", "digest"))
    members = real.select(F.col("id").alias("doc"), "digest").join(classes.select("digest", "id"), "digest").select("doc", "id")
    return classes, cut(members)


def sets_of(named: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, shingles: the full sets of the wanted classes (id, least, digest), from the texts (id, text) of their least documents."""
    texts = named.withColumnRenamed("id", "least").join(wanted, "least").groupBy("least", "id", "digest", F.md5("text").alias("h")).agg(F.min("text").alias("text"))
    sets = cut(texts.select("id", "digest", "text").mapInArrow(_sets, "id long, shingles array<long>"))
    # A document id that comes with several texts of one set has brought that set more than once.
    if sets.groupBy("id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").isEmpty():
        return sets
    return cut(sets.groupBy("id").agg(F.first("shingles").alias("shingles")))


def group(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept, digest for each row of docs.

    Documents are linked if 100 * |intersection| >= percent * |union| of their sets of five-word shingles. component_id is
    the smallest id that can be reached over links, and the document of that id is kept. Null and empty texts and those
    without words have the empty set and are linked with nothing. Rows of the same id are one document: it is linked with
    whatever any of its texts is linked with, and its rows are kept or not together. A row with a null id takes no part: its
    component is null and it is kept. Other columns are not read; an empty table gives an empty result.
    """
    rows = rows_per_band(percent / 100)
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sketched = cut(named.mapInArrow(_sketch(rows), "id long, n_shingles long, digest binary, bands array<long>"))
    classes, owned = classes_of(sketched.filter("id is not null and n_shingles > 0"))

    hung = classes.select("id", "n", F.explode("bands").alias("key"))
    buckets = hung.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("other")).filter("leader < other").select("key", "leader")
    members = cut(hung.join(buckets, "key"))
    first = cut(members.filter("id > leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct())

    sets = sets_of(named, classes.join(members.select("id").distinct(), "id", "left_semi").select("id", "least", "digest"))
    links = cut(confirmed(first, sets, percent))
    joined = components(links)

    # Buckets also gather texts that share a passage only. Those still apart meet again on their rarest shingles.
    place, apart = _apart(members, joined)
    if apart:
        members = cut(rarest(sets.join(place.select("id").distinct(), "id", "left_semi"), percent))
        place, apart = _apart(members, joined)

    # What is apart even so is compared with a few leaders, and then by how it differs from the group's middle.
    if apart:
        hubs = place.join(place.groupBy("key").agg(F.min("id").alias("hub")), "key").filter("id != hub")
        tops = components(hubs.select(F.col("hub").alias("a"), F.col("id").alias("b"))).select(F.col("node").alias("id"), F.col("component").alias("top"))
        deltas = spread(tops, sets)
        links = cut(links.unionByName(confirmed(leading(deltas, percent).join(first, ["a", "b"], "left_anti"), sets, percent)))
        joined = components(links)
        more = confirmed(cut(differing(deltas, joined, percent).join(first, ["a", "b"], "left_anti")), sets, percent)
    else:
        more = links.limit(0)

    # A document with several texts links their classes.
    several = owned.groupBy("doc").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b").select("doc", "a")
    one = owned.join(several, "doc").filter("id != a").select("a", F.col("id").alias("b"))
    more = cut(more.unionByName(one))
    if not more.isEmpty():
        joined = components(links.unionByName(more))

    whole = classes.select("id", "least").join(joined.withColumnRenamed("node", "id"), "id", "left").select("id", "least", F.coalesce("component", "id").alias("component"))
    smallest = cut(whole.groupBy("component").agg(F.min("least").alias("component_id")))
    named_classes = whole.join(smallest, "component").select("id", "component_id")
    placed = owned.join(named_classes, "id").select("doc", "component_id").distinct()
    component = F.coalesce("component_id", "id")
    return sketched.join(placed, sketched["id"] == placed["doc"], "left").select(
        F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), F.hex("digest").alias("digest")
    )


def representatives(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that are not kept."""
    gone = group(docs, percent, id_col, text_col).filter("not kept").select(F.col(id_col).alias("gone")).distinct()
    return docs.select(F.struct("*").alias("row")).join(gone, F.col("row")[id_col] == F.col("gone"), "left_anti").select("row.*")


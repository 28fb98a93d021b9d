"""The folds against plain Python, and cases of their own."""

import json
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from veriframe.functions import folds as D
from veriframe.operators import relational as R
from veriframe.operators import rules as S


def column(spark, texts, f):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["x"] for r in df.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


def osa(a, b, limit=3):
    table = {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                table[i, j] = i + j
                continue
            table[i, j] = min(table[i - 1, j] + 1, table[i, j - 1] + 1, table[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                table[i, j] = min(table[i, j], table[i - 2, j - 2] + 1)
    return min(table[len(a), len(b)], limit + 1)


def words(rng, n, letters="abc", most=7):
    return ["".join(rng.choices(letters, k=rng.randint(0, most))) for _ in range(n)]


def test_near_pairs_are_not_broadcast(spark):
    """What is filed is many times the texts, so neither side may go to the driver; and pairs are distinct before they are measured."""
    a = spark.range(9).select(F.lpad(F.col("id").cast("string"), 8, "abcd").alias("p"))
    physical = R.near_pairs(a, a.withColumnRenamed("p", "v"), "p", "v")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in physical
    join = next(line for line in physical.splitlines() if "SortMergeJoin" in line)
    assert "aggregate(" not in join


def test_osa_and_deletions(spark):
    rng = random.Random(4)
    pairs = list(zip(words(rng, 300), words(rng, 300), strict=True)) + [("ab", "ba"), ("ca", "abc"), ("kitten", "sitting"), ("abcdef", "a"), ("日本é", "é日本"), ("", "")]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", D.osa_distance(F.col("a"), F.col("b")).alias("d"), F.arrays_overlap(D.deletions(F.col("a"), 2), D.deletions(F.col("b"), 2)).alias("met")).collect():
        assert r["d"] == osa(r["a"], r["b"]) and (r["met"] or r["d"] > 2)
    none = spark.createDataFrame([(None, "a"), ("a", None)], "a string, b string")
    assert [r["d"] for r in none.select(D.osa_distance(F.col("a"), F.col("b")).alias("d")).collect()] == [None, None]


def test_near_pairs_are_all_pairs_that_are_close(spark):
    rng = random.Random(8)
    one, two = words(rng, 60, "xy", 9), words(rng, 60, "xy", 9)
    a, b = spark.createDataFrame([(w,) for w in [*one, None]], "p string"), spark.createDataFrame([(w,) for w in [*two, None]], "v string")
    got = sorted((r["p"], r["v"], r["_d"]) for r in R.near_pairs(a, b, "p", "v", 2, 2).collect())
    assert got == sorted((p, v, osa(p, v)) for p in set(one) for v in set(two) if p[:2] == v[:2] and osa(p, v) <= 2)
    ranked = [(r["p"], r["v"], r["distance"], r["rank"]) for r in S.suggestions(a, b, "p", "v", limit=3, family=1, most=2).collect()]
    want = []
    for p in set(one):
        close = sorted((min(osa(p, v), 3), v) for v in set(two) if p[:1] == v[:1])[:3]
        want += [(p, v, d, i + 1) for i, (d, v) in enumerate(close)]
    assert sorted(ranked) == sorted(want)


def json_objects(text):
    def once(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError
        return dict(pairs)

    decoder, found, at = json.JSONDecoder(object_pairs_hook=once), [], text.find("{")
    while at >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
            found.append(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False))
        except ValueError:
            end = at + 1
        at = text.find("{", end)
    return found


def test_json_objects(spark):
    texts = [
        "", "no", '{"b":1,"a":[1,{"x":"}{"}]} tail {"c":2}', '{bad {"a": 1}', '{"a":1,"a":2} {"z":"q\\"{"}', 'say "hi {" {"k": "v"} {', '{{"a":1}}', '{"a":{"b":2}',
        '{"é":"日本","n":1.5,"f":false,"g":null}', 'x {"a":"un\nclosed"} {"b":[]}', '}{"a":1}{', '{"a":"\\u00e9"}{}', 'x {"a": {"b": 1}} y {bad} {"c": 2} {"d":1,"d":2}',
    ]
    rng = random.Random(2)
    texts += ["".join(rng.choices(['{"a":', "{", "}", "1", '"', '"x"', ",", "[", "]", "\\", " "], k=rng.randint(1, 14))) for _ in range(150)]
    assert column(spark, texts, D.json_objects) == [json_objects(t) for t in texts]
    assert column(spark, [None], D.json_objects) == [[]]


def test_repair(spark):
    cases = {
        '```json\n{"a": [1, 2,\n// no\n "b"': '{"a": [1, 2,\n "b"]}', '```json\n{"a":1,}\n```': '{"a":1}', '{"a":"b': '{"a":"b"}', '{"x":"{[", "y":[1,{"z":2': '{"x":"{[", "y":[1,{"z":2}]}',
        '{"m":"M","price":': '{"m":"M","price":""}', '{"m":"M","price": 12': '{"m":"M","price": 12}', '{"m":"M","price":"12': '{"m":"M","price":"12"}', '{"a":1}': '{"a":1}', "": "", None: None,
    }
    assert column(spark, list(cases), D.repair_json) == list(cases.values())


def test_answers(spark):
    cases = {
        'so\n{"a": 1}\n{bad}': '{"a":1}', 'text {"model": "M",\n"x": 1} end': '{"model":"M","x":1}', '{"model": 1,\n"x": {"view_type": 2}}': None, '```json\n{"q":\n 2}\n```': '{"q":2}',
        '{"other":\n1}': None, "none": None, None: None, '{"a": 1}\n{"model":\n2}': '{"a":1}',
    }
    assert column(spark, list(cases), lambda c: D.answer_json(c, ["view_type", "model"])) == list(cases.values())


def looping(text):
    """The rules once more, over a whole answer."""
    try:
        value = json.loads(text.strip().replace("```json", "").replace("```", ""))
    except ValueError:
        value = None
    if isinstance(value, dict):
        text = value.get("narration") or value.get("desc") or ""
    elif "{" in text:
        text = text.split("{", 1)[0].strip()
    counts = Counter(t for t in re.findall("[A-Za-z0-9]+(?::[A-Za-z0-9]+)?|[一-鿿]{2,}", text)[-120:] if len(t) >= 4)
    tail = re.sub(r"\s+", "", text)[-1600:]
    lines = [x for x in map(str.strip, text.split("\n")) if len(x) > 15]
    windows = len(lines) >= 2 and len(text) > 200 and any(text.count(text[i : i + 30]) >= 3 for i in range(0, len(text) - 30, 50))
    chunks = any(len(tail) >= 8 * n and tail.endswith(tail[-n:] * 6) for n in D.LOOP_CHUNKS)
    return any(n >= 12 for n in counts.values()) or chunks or len(set(lines[-15:])) < len(lines[-15:]) or windows


def filler(n, start=0):
    return " ".join(f"{i:x}q{i * i:o}" for i in range(start, start + n))


def test_loops(spark):
    passage = "the very same thirty characters and more of them stand here "
    late = filler(400) + " " + "".join(passage + filler(40, 1000 + 100 * k) + " " for k in range(4)) + filler(100, 5000)
    cases = {
        "": False, "spam " * 20: True, "a few quite different words stand here": False, filler(800): False,
        late: False,  # one line only: windows are not looked at
        late + "\nand a second line of some length": True,
        filler(50) + "\nseventeen letters\n" + filler(3, 700) + "\nseventeen letters": True,
        "fine words here {" + '"a": "spam spam spam",' * 40: False, "spam " * 20 + '{"a": 1}': True,
        json.dumps({"narration": "all is well", "desc": "spam " * 20}): False, json.dumps({"narration": "", "desc": "spam " * 20}): True, "```json\n" + json.dumps({"desc": "spam " * 20}) + "\n```": True,
        json.dumps(["spam " * 20]): True, "1000000:1 " * 12: True, "1000000:1 " * 11 + "end": False,
    }
    cases |= {filler(50) + "abc!defgh?ijklm+nop=qrs-tuv_wxy.ABC,DEF;GHIJ"[:size] * 8: True for size in (10, 12, 20, 24, 40)}
    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choices(["ab", "a", "\n", "abcab" * 3, "x" * rng.randint(1, 70), "the same old words again, "], k=rng.randint(0, 40))) + filler(30) * rng.randint(0, 1)
        cases[text] = looping(text)
    assert all(looping(t) == want for t, want in cases.items())
    assert column(spark, list(cases), lambda c: D.loops(D.watched_prose(c))) == list(cases.values())
    assert column(spark, [None], lambda c: D.loops(D.watched_prose(c))) == [False]


def test_loops_of_long_texts(spark):
    """Long texts without a run of 30 that comes twice are not searched window by window: in time by their length."""
    import time

    rng = random.Random(3)
    line = lambda: "".join(rng.choices("abcdefghij ", k=60))
    plain = "\n".join(line() for _ in range(6000))
    short = plain[:9000]
    window = short[50 * 40 : 50 * 40 + 30]
    cases = {short: False, short + "-" + window + "+" + line() + window: True, short + "-" + window: False}
    started = time.time()
    assert column(spark, [plain], D.loops) == [False]
    assert time.time() - started < 15
    assert column(spark, list(cases), D.loops) == list(cases.values())


def test_staged_match_broadcasts_nothing(spark):
    a = spark.range(9).select(F.lpad(F.col("id").cast("string"), 12, "abcd").alias("p"))
    plan = R.staged_match(a, a.withColumnRenamed("p", "v"), "p", "v")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_staged_match_takes_only_what_is_sure(spark):
    catalog = spark.createDataFrame([(v,) for v in ["S27HG806EF", "S27HG807EF", "S32FM703UC", "S32FM703UX", "S40AB100UC", None]], "v string")
    want = {
        "S27HG806EF": ("S27HG806EF", "exact"), "S40AB100": ("S40AB100UC", "completion"), "S40AB1_0UC": ("S40AB100UC", "nearest"), "S27HG807FE": ("S27HG807EF", "nearest"),
        "S32FM703": (None, None), "S32FM703U": (None, None), "S27HG80_EF": (None, None), "S99": (None, None), None: (None, None),
    }
    probe = spark.createDataFrame([(p,) for p in [*want, "S40AB100", "S40AB1_0UC"]], "p string")
    got = [(r["p"], (r["matched"], r["stage"])) for r in R.staged_match(probe, catalog, "p", "v").collect()]
    assert len(got) == len(want) + 2 and dict(got) == want


def test_unique_nearest_is_the_one_closest(spark):
    """At one edit or two, with ties at either, against all pairs; whichever is near enough for the probe's length."""
    rng = random.Random(5)
    texts = lambda n: {"xy"[rng.random() < 0.3] + "".join(rng.choices("abcd", k=rng.randint(5, 10))) for _ in range(n)}
    typed = lambda v: "".join(c for c in v if rng.random() > 0.1) + "e" * (rng.random() < 0.5)
    values = texts(300)
    probes = {typed(v) for v in values} | texts(50) | set(list(values)[:20])
    near = R.unique_nearest(spark.createDataFrame([(p,) for p in [*probes, None]], "p string"), spark.createDataFrame([(v,) for v in [*values, None]], "v string"), "p", "v", 1)
    want = {None: (None, None)}
    for p in probes:
        close = sorted((osa(p, v), v) for v in values if p[:1] == v[:1])
        sure = bool(close) and close[0][0] <= (2 if len(p) >= 9 else 1 if len(p) >= 8 else 0) and [d for d, _ in close].count(close[0][0]) == 1
        want[p] = (close[0][1], close[0][0]) if sure else (None, None)
    assert {r["p"]: (r["nearest"], r["distance"]) for r in near.collect()} == want
    assert {d for _, d in want.values()} == {None, 0, 1, 2}


def test_two_edits_are_sought_only_where_one_finds_nothing(spark):
    """The values that are filed for two edits are those of families with a probe still open; nothing is broadcast."""
    a = spark.range(9).select(F.lpad(F.col("id").cast("string"), 12, "abcd").alias("p"))
    plan = R.unique_nearest(a, a.withColumnRenamed("p", "v"), "p", "v")._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "LeftSemi" in plan and "Broadcast" not in plan

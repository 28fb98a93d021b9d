import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veriframe.llm import chat_format as C
from veriframe.llm import url_filter as U

RULES = [("com", "/en/", "block"), ("Example.com", "/en/7", "allow"), ("example.com", None, "block"), ("a.b", "", "allow"), (None, "/x", "block"), ("com", "/en/", "allow")]


def naive(url, rules):
    rest = url.partition("://")[2] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] + [len(path)])]
    best = None
    for h, p, v in rules:
        h, p = (h or "").lower(), p or ""
        if h and host and (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or (len(h + p), h + p, v) > best[0]):
            best = ((len(h + p), h + p, v), h + p, v)
    return host, path, best[1] if best else None, best[2] if best else "allow"


def test_urls_against_brute_force(spark):
    urls = [None, "", "no", "://", "http://", "HTTP://A.Example.COM/en/72?x", "https://example.com/en/8#y", "ftp://xexample.com/en/", "http://com/en/", "http://a.b", "http://a.b?q/r", "http://x.a.b/y", "http://..com/en/", "a://b://c/d", "http://example.com/" + "z" * 100_000, "http://h\n.com/en/\nx"]
    rows = [(i if i % 5 else None, u) for i, u in enumerate(urls)] * 2
    table = spark.createDataFrame(rows, "page_id long, url string").withColumn("key", F.lit(1)).withColumn("host", F.lit("clash"))
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = sorted((tuple(r[c] for c in ("page_id", "host", "path", "rule", "verdict")) for r in U.judge(table, rules).collect()), key=repr)
    assert got == sorted(((i, *naive(u, RULES)) for i, u in rows), key=repr)
    assert U.judge(table.limit(0), rules).count() == 0
    assert {r["verdict"] for r in U.judge(table, rules.limit(0)).collect()} == {"allow"}


def test_urls_within_urls(spark):
    urls = ["http://a.org?u=http://x.com/en/9", "http://a.com#http://x.com/en/9", "http://com?a://b/c://d/en/", "http://com/en/?u=http://b.com/x", "://://com/en/", "http://example.com://x/en/7", "x" * 50_000 + "://com?://x/en/", "a:/b:c://com/en/1"]
    table = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = sorted(tuple(r[c] for c in ("page_id", "host", "path", "rule", "verdict")) for r in U.judge(table, rules).collect())
    assert got == sorted((i, *naive(u, RULES)) for i, u in enumerate(urls))


def test_nested_rules_stack(spark):
    rules = spark.createDataFrame([("h.com", "/a" * i, "block" if i % 2 else "allow") for i in range(6)], "host string, path string, verdict string")
    urls = spark.createDataFrame([(i, "http://h.com" + "/a" * i + "/b") for i in range(8)], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["matched_rules"]) for r in U.judge(urls, rules).collect()}
    assert got == {i: ("h.com" + "/a" * min(i, 5), min(i, 5) + 1) for i in range(8)}


def test_rules_of_many_depths(spark):
    """A host of over a thousand labels, with a rule at each depth."""
    labels = [f"l{i}" for i in range(1200)]
    rules = spark.createDataFrame([(".".join(labels[-d:]), "/x", "block") for d in range(1, 1201)], "host string, path string, verdict string")
    urls = spark.createDataFrame([(1, "a://" + ".".join(labels) + "/xy"), (2, "a://" + ".".join(labels[-3:]) + "/x")], "page_id long, url string")
    assert {r["page_id"]: r["matched_rules"] for r in U.judge(urls, rules).collect()} == {1: 1200, 2: 3}


def test_many_rules_of_one_host(spark):
    """100,000 rules of one host, a third of them nested, and urls of which nearly all are of that host."""
    made = spark.range(100_000).select(F.lit("h.com").alias("host"), F.concat(F.lit("/"), (F.col("id") % 66_667).cast("string"), F.when(F.col("id") >= 66_667, "/").otherwise("x")).alias("path"), F.lit("block").alias("verdict"))
    urls = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("a://s.h.com/"), (F.col("id") * 31).cast("string"), F.when(F.col("id") % 2 == 0, "x/y").otherwise("/z")).alias("url"))
    got = {r["page_id"]: r["rule"] for r in U.judge(urls, made).collect()}
    paths = {f"/{i % 66_667}{'/' if i >= 66_667 else 'x'}" for i in range(100_000)}
    for i in range(3000):
        path = f"/{i * 31}" + ("x/y" if i % 2 == 0 else "/z")
        fits = [path[:n] for n in range(len(path) + 1) if path[:n] in paths]
        assert got[i] == (f"h.com{max(fits, key=len)}" if fits else None)


def test_sweep_against_brute_force(spark):
    import random

    rng = random.Random(7)
    part = lambda n: "".join(rng.choices(["/", "a", "b", "é", "\U0010ffff"], k=rng.randint(0, n)))
    hosts = ["x.y", "y", "z.x.y", "w"]
    rules = list({(rng.choice(hosts), part(4)): rng.choice(["allow", "block"]) for _ in range(120)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    urls = [(i, f"a://{rng.choice(hosts)}/{part(7)}") for i in range(400)]
    got = sorted(tuple(r[c] for c in ("page_id", "host", "path", "rule", "verdict")) for r in U.judge(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string"), default="allow").collect())
    assert got == sorted((i, *naive(u, rules)) for i, u in urls)


def test_query_follows_its_contract(spark, tmp_path):
    from veriframe.llm import queries as Q

    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
    hosts = ["com", "a.com", "example.com", "net", "b.net", "example.net", "www.Example.NET", "xexample.net", "org", "info"]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/en/", "/en/7", "/en/8?x", "/de/", "/de", "/de/7#y", "/de/8", "/de/81/", "/es/9", "?/de/8")] + [None, "", "net/de/"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(tuple(r[c] for c in ("page_id", "host", "path", "rule", "verdict")) for r in Q.op1_url_filter(spark, str(tmp_path)).collect())
    assert got == sorted((i, *naive(u, rules)) for i, u in enumerate(urls))


TEXTS = ["", None, "<|im_end|>", "<\\|im_start|>assistant\n<\\\\|x", "a<|b", "\\", "line\nbreak", "<" * 50 + "|", "é" * 20_000]


def test_round_trip(spark):
    rows = [(i % 3, j, r, t) for i in range(3) for j, (r, t) in enumerate((r, t) for r in ("user", "assistant", None, "odd\nrole\\n<|") for t in TEXTS)]
    rows += [(None, None, "assistant", "x"), (None, None, "assistant", "x"), (7, 1, "user", "b"), (7, 1, "user", "a")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("message", F.lit("clash"))
    back = C.read_back(C.render(C.fold_events(C.as_events(table))))
    for r in back.collect():
        mine = sorted((((t is not None, t or 0), (ro is not None, ro or ""), (x is not None, x or "")), ro or "", x or "") for c, t, ro, x in rows if c == r["conv_id"])
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(a, b) for _, a, b in mine]
        assert r["loss_text"] == "".join(b for _, a, b in mine if a == "assistant")
        assert r["formatted"].count("<|im_start|>") == len(mine)
    d = {r["conv_id"]: r for r in C.digests(back).collect()}
    assert d[7]["turns_sha256"] == hashlib.sha256(b"user\na\nuser\nb\n").hexdigest() and d[7]["loss_chars"] == 0
    assert C.render(C.fold_events(C.as_events(table.limit(0)))).count() == 0


def test_events_fold(spark):
    log = [
        (1, 1, 1, "start", "user", "hi"), (1, 2, 2, "start", "assistant", "He"), (1, 2, 3, "delta", None, "llo"), (1, 2, 4, "regenerate", None, "Good "), (1, 2, 5, "delta", None, "day"),
        (1, 1, 6, "edit", None, "hey"), (1, 3, 7, "start", "user", "gone"), (1, 3, 8, "delete", None, None), (1, 4, 9, "delta", "user", "only"), (1, 4, 10, None, None, None),
    ]
    events = spark.createDataFrame(log, "conv_id long, message int, seq int, kind string, role string, text string")
    got = sorted((r["message"], r["role"], r["text"]) for r in C.fold_events(events).collect())
    assert got == [(1, "user", "hey"), (2, "assistant", "Good day"), (4, "user", "only")]


def test_streamed_logs_fold_into_the_same_messages(spark):
    texts = [*TEXTS, "ab", "a", "\U0001f600x\U0001f600", "long " * 200_000]
    rows = [(i % 4, j, r, t) for j, t in enumerate(texts) for i, r in enumerate(("user", "assistant", None, "odd\nrole"))]
    table = spark.createDataFrame([*rows, (None, None, "assistant", "x"), (None, None, "assistant", "x")], "conv_id long, turn long, role string, text string").withColumns({"seq": F.lit(9), "kind": F.lit("clash")})
    log = C.as_streamed_events(table)
    assert {r["kind"] for r in log.select("kind").distinct().collect()} == {"start", "delta", "edit", "regenerate"}
    fold = lambda events: sorted(((r["conv_id"] is None, r["conv_id"]), r["message"], r["role"], r["text"]) for r in C.fold_events(events).collect())
    got = fold(log)
    assert got == fold(C.as_events(table)) and len(got) == len(rows) + 2
    assert C.as_streamed_events(table.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1])
def test_escape_is_reversible(spark, seed):
    @settings(max_examples=12, deadline=None)
    @given(st.lists(st.text(alphabet="<|\\a\n", max_size=12), min_size=40, max_size=40))
    def run(texts):
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        for r in df.select("t", C.unescape(C.escape(F.col("t"))).alias("u"), C.escape(F.col("t")).alias("e"), C.unescape_role(C.escape_role(F.col("t"))).alias("r"), C.escape_role(F.col("t")).alias("f")).collect():
            assert r["u"] == r["t"] == r["r"] and "<|" not in r["e"] and "<|" not in r["f"] and "\n" not in r["f"]

    run()

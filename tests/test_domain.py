from pyspark.sql import functions as F

from veriframe.functions import domain as D


def first(spark, expression, **columns):
    df = spark.range(1)
    for k, v in columns.items():
        df = df.withColumn(k, v if not isinstance(v, str) else F.lit(v))
    return df.select(expression.alias("x")).first()["x"]


def test_resolution(spark):
    c = F.col
    assert first(spark, D.resolve([c("a"), c("b")]), a="m", b="N/A") == "m"
    assert first(spark, D.resolve([c("a"), c("b")]), a="m", b="n") == "unresolved"
    assert first(spark, D.resolve([c("a")], F.lit("f")), a=" ") == "f"
    assert first(spark, D.canonical_family(c("a"), ["43", "32"], ["M5", "M7"], ["43-M7-PRO", "32-M5"]), a="followme m7 43 pro") == "43-M7-PRO"
    assert first(spark, D.canonical_family(c("a"), ["43", "32"], ["M5", "M7"], ["43-M7-PRO", "32-M5"]), a="43 m5") is None


def test_text(spark):
    c = F.col("a")
    assert first(spark, D.convert_script(c, {"国": "國"}, {"國家": "國 家"}), a="国家") == "國 家"
    assert first(spark, D.residual(c, "国体"), a="体a国体") == ["体", "国"]
    assert first(spark, D.clean_stream(c, ["嗯"]), a="嗯，好") == "好"
    assert first(spark, D.last_json_line(c), a='x\n{"a":1}\n{bad}\n{"b":2}\nend') == '{"b":2}'
    got = first(spark, D.fallback_fields(c, ["S27HG806EF"]), a="ABCDEFGHIJKLMN s27hg806ef 1999 2999 2999 1999 12")
    assert (got["model"], got["price"], got["requires_retry"]) == ("S27HG806EF", "1999", True)
    assert first(spark, D.fallback_fields(c, []), a="")["model"] is None


def test_evidence(spark):
    e = F.from_json(F.lit('[{"cue":"a","strength":"strong"},{"cue":"b","strength":"strong"},{"cue":"a","strength":"weak"},{"cue":"z","strength":"strong"}]'), "array<struct<cue:string,strength:string>>")
    got = first(spark, D.normalise_evidence(F.col("e"), ["a", "b"], ["b"]), e=e)
    assert [(x["cue"], x["strength"]) for x in got] == [("a", "strong"), ("b", "weak")]
    assert first(spark, D.evidence_errors(F.col("e"), ["a", "b"]), e=e) == ["invalid_cue:z", "duplicate_cue"]
    assert first(spark, D.sufficient_evidence(F.col("e"), 3), e=e) is True and first(spark, D.sufficient_evidence(F.col("e"), 4), e=e) is False


def test_merge_objects_fails_closed(spark):
    def merged(*objects):
        found = F.array(*map(F.lit, objects)).cast("array<string>")
        r = first(spark, D.merge_objects(found, ["model", "price"], ["cue"], ["note"]))
        return r["mode"], r["reason"], r["merged"]

    assert merged() == ("none", "no_valid_json_object", None)
    assert merged('{"model":"A","evidence":{"cue":"x"}}') == ("single_object", "", {"model": "A", "cue": "x"})
    assert merged('{"evidence":{"zoo":1,"ape":2}}')[:2] == ("rejected", "evidence_container_unknown_keys:ape,zoo")
    assert merged('{"cue":"a","evidence":{"cue":"x"}}')[:2] == ("rejected", "duplicate_nested_evidence_keys:cue")
    assert merged('{"evidence":[1]}')[:2] == ("rejected", "evidence_container_not_object")
    assert merged('{"note":"n"}', '{"price":5}') == ("disjoint_core_evidence", "", {"price": "5", "note": "n"})
    assert merged('{"price":5}', "{}")[:2] == ("rejected", "multiple_core_or_unknown_object")
    assert merged('{"price":5}', '{"zoo":1}')[:2] == ("rejected", "evidence_object_has_unknown_keys")
    assert merged('{"price":5,"cue":"a"}', '{"cue":"a"}')[:2] == ("rejected", "duplicate_core_evidence_keys")


def test_shape_error(spark):
    kinds = {"id": ["STRING"], "n": ["BIGINT", "VOID"], "ok": ["BOOLEAN"]}
    error = lambda text, expected="7": first(spark, D.shape_error(F.lit(text), kinds, "id", F.lit(expected)))
    assert error('{"id":" 7 ","n":null,"ok":true}') == ""
    assert error("[1]") == error("{broken") == error(None) == "not_object"
    assert error('{"n":1}') == "missing:id,ok"
    assert error('{"id":"7","n":1,"ok":true,"b":1,"a":2}') == "extra:a,b"
    assert error('{"id":"","n":1,"ok":true}') == "id_missing"
    assert error('{"id":"8","n":1,"ok":true}') == "id_mismatch"
    assert error('{"id":"7","n":true,"ok":true}') == "n_invalid"
    assert error('{"id":"7","n":1,"ok":null}') == "ok_invalid"

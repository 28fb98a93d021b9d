
import pytest
from pyspark.sql import functions as F

from veriframe.functions import text as T


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expression(F.col("c")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "f,value,want",
    [
        (T.clean, "  N/A ", None), (T.clean, " a ", "a"), (T.blank_to_null, "  ", None), (T.loose_int, "1,234.9", 1234), (T.loose_int, "x", 0), (T.loose_int, "12.5", 12),
        (T.digits_int, "12.5", 125), (T.digits_int, "abc", None), (T.strict_int, "12.5", 0), (T.strict_int, " 12 ", 12), (T.price_digits, "NT$ 12,900", "12900"), (T.price_digits, "1.2.3", None), (T.price_digits, "99.7", "99"),
        (T.strip_model, "LS27HG806EFXZW", "S27HG806EF"), (T.compact, "a-b 1", "AB1"), (T.year_of, "photo 2024x", 2024), (T.period_of, "x_202413", None), (T.period_of, "x_202412_y", "202412"), (T.period_of, "1202412", None),
        (T.sanitize_segment, '27" a/b  c__', "27吋_a_b_c"), (T.sanitize_segment, "  ", "unknown"), (T.strip_html, "<p>a&amp;b</p><script>x</script> c", "a&b c"), (T.truthy, "YES", True), (T.truthy, None, False),
        (T.group_label, "M1-a-b-c-d-007", "m1-a-b-c-d"), (T.group_label, "shot_12", "shot"), (T.path_key, "A\\B", "a/b"),
    ],
)
def test_scalars(spark, f, value, want):
    assert one(spark, value, f) == want


def test_negation_window(spark):
    f = lambda c: T.unnegated(c, "risk", ["no "])
    assert one(spark, "no risk here", f) is False
    assert one(spark, "no risk but a " + "x" * 30 + " risk", f) is True
    assert one(spark, None, f) is False
    assert one(spark, "nothing", f) is False


def test_sets_and_json(spark):
    assert one(spark, "a; b;;a", T.split_set) == ["a", "b"]
    assert one(spark, "a;c", lambda c: T.translate_set(c, {"a": "A"})) == "A；c"
    assert one(spark, '{"a":1,"c":2}', lambda c: T.json_shape(c, ["a", "b"])) == ["missing:b", "extra:c"]
    assert one(spark, "[1]", lambda c: T.json_shape(c, ["a"])) == ["not_an_object"]
    assert one(spark, 7, T.backoff_seconds, "int") == 300
    assert one(spark, 2, T.backoff_seconds, "int") == 30
    assert one(spark, "2024-01-02T03:04:05Z", lambda c: T.parse_time(c).cast("string")) == "2024-01-02 03:04:05"
    assert one(spark, "12990", lambda c: T.one_inserted(c, F.lit("1299"))) is True

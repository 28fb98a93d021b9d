"""Column helpers for messy text, numbers, names and dates. All are native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that stand for a missing value, by place of use.
NULL_WORDS = ("null", "none", "n/a")
NULL_WORDS_WITH_NAN = (*NULL_WORDS, "nan")
TRUE_WORDS = ("1", "true", "yes", "y")


def blank_to_null(c: Column) -> Column:
    """Trimmed text, null if nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def clean(c: Column, words=NULL_WORDS) -> Column:
    """Trimmed text, null if it is blank or one of the words for missing values."""
    t = blank_to_null(c)
    return F.when(~F.lower(t).isin(*words), t)


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin(*TRUE_WORDS), F.lit(False))


def present(c: Column) -> Column:
    """Neither null nor the empty text; `0` counts as present."""
    return F.coalesce(c, F.lit("")) != ""


def compact(c: Column) -> Column:
    """Upper case, letters and digits only."""
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def loose_int(c: Column, default: int = 0) -> Column:
    """Commas dropped, then the number cut to an integer; what is none becomes the default."""
    return F.coalesce(F.replace(c, F.lit(","), F.lit("")).try_cast("double").try_cast("int"), F.lit(default))


def digits_int(c: Column) -> Column:
    """The digits of the text as one number, whatever stands between them; null without digits."""
    return F.nullif(F.regexp_replace(c, "[^0-9]", ""), F.lit("")).try_cast("bigint")


def strict_int(c: Column, default: int = 0) -> Column:
    """An integer as such, else the default."""
    return F.when(c.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(c).try_cast("int")).otherwise(F.lit(default))


def price_digits(c: Column) -> Column:
    """A price's text with digits and points only; with a point, cut to whole units; null if that is no number."""
    t = F.nullif(F.regexp_replace(c, "[^0-9.]", ""), F.lit(""))
    return F.when(t.contains("."), t.try_cast("double").try_cast("bigint").cast("string")).otherwise(t)


def strip_model(c: Column) -> Column:
    """A product code without the leading L before a letter and two digits and without the trailing XZW."""
    return F.regexp_replace(F.regexp_replace(compact(c), "^L(?=[A-Z][0-9]{2})", ""), "XZW$", "")


def distinct_matches(c: Column, pattern: str, group: int = 0) -> Column:
    """All matches in order of appearance, each once."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)))


def any_keyword(c: Column, words: list[str]) -> Column:
    """Whether any of the literals occurs."""
    return F.coalesce(F.exists(F.array(*map(F.lit, words)), lambda w: c.contains(w)), F.lit(False))


def hit_terms(c: Column, words: list[str]) -> Column:
    return F.filter(F.array(*map(F.lit, words)), lambda w: c.contains(w))


def unnegated(c: Column, term: str, negations: list[str], window: int = 28) -> Column:
    """Whether the term occurs anywhere without a negation in the `window` characters before it."""
    pieces = F.split(c, f"\\Q{term}\\E", -1)
    # The fold carries the last characters before each occurrence, which may reach back over earlier ones, and no more.
    start = F.struct(F.lit("").alias("tail"), F.lit(False).alias("hit"))
    free = lambda x: ~F.exists(F.array(*map(F.lit, negations)), lambda n: x.contains(n))

    def step(a, piece):
        reach = F.right(F.concat(a["tail"], piece), F.lit(window))
        return F.struct(F.right(F.concat(reach, F.lit(term)), F.lit(window)).alias("tail"), (a["hit"] | free(reach)).alias("hit"))

    return F.coalesce(F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), start, step)["hit"], F.lit(False))


def clause_any(c: Column, predicate) -> Column:
    """Whether any clause of the text satisfies the predicate."""
    return F.exists(F.split(c, "[。；;\n]+"), predicate)


def sanitize_segment(c: Column, default: str = "unknown") -> Column:
    """A name's segment: white space and invalid characters become `_`, runs of it one, its ends trimmed."""
    t = F.replace(F.replace(c, F.lit('"'), F.lit("吋")), F.lit("”"), F.lit("吋"))
    t = F.regexp_replace(t, r"\s+", "_")
    t = F.regexp_replace(t, r'[<>:/\\|?*\x00-\x1f]', "_")
    t = F.btrim(F.regexp_replace(t, "_+", "_"), F.lit(" ._"))
    return F.coalesce(F.nullif(t, F.lit("")), F.lit(default))


def name_parts(c: Column) -> Column:
    return F.split(c, "-", -1)


def build_name(*parts: Column) -> Column:
    """Segments that are present, joined by hyphens."""
    return F.concat_ws("-", *[blank_to_null(p) for p in parts])


def group_label(c: Column) -> Column:
    """A file's group: of six or more parts with an M head all but the serial, else the name without a trailing number."""
    p = F.split(c, "[-_]", -1)
    head = F.lower(F.array_join(F.slice(p, F.lit(1), F.size(p) - 1), "-"))
    return F.when((F.size(p) >= 6) & F.upper(F.get(p, F.lit(0))).startswith("M"), head).otherwise(F.lower(F.regexp_replace(c, r"[_-]\d+$", "")))


def strip_html(c: Column) -> Column:
    """Text without scripts, styles and tags; `&nbsp;` and `&amp;` decoded, white space collapsed."""
    t = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    t = F.regexp_replace(t, "<[^>]+>", " ")
    t = F.replace(F.replace(t, F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&"))
    return F.btrim(F.regexp_replace(t, r"\s+", " "))


def path_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"\\", "/"))


def year_of(c: Column) -> Column:
    """The first 20xx in the text."""
    return F.nullif(F.regexp_extract(c, r"20\d\d", 0), F.lit("")).try_cast("int")


def period_of(c: Column) -> Column:
    """The first YYYYMM with a month of 01 to 12 and no digit around it."""
    return F.nullif(F.regexp_extract(c, r"(^|[^0-9])(20[0-9]{2}(0[1-9]|1[0-2]))([^0-9]|$)", 2), F.lit(""))


def include_symbol(period: Column, current_year: int) -> Column:
    """Whether a comparison symbol belongs in the name: only in the current year; an unknown period counts as it."""
    return F.coalesce(year_of(period) == current_year, F.lit(True))


def parse_time(c: Column) -> Column:
    """ISO 8601 with a zone or Z; anything else is null."""
    return F.try_to_timestamp(F.regexp_replace(c, "Z$", "+00:00"))


def from_mtime_ns(c: Column) -> Column:
    """A time in nanoseconds, in whole microseconds; exact, as no fraction is divided."""
    return F.timestamp_micros(F.call_function("div", c, F.lit(1000)))


def stable_id(c: Column) -> Column:
    return F.sha2(F.lower(c), 256)


def composite_key(*parts: Column, length: int = 64) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length)


def canonical_json(*columns: str) -> Column:
    """A JSON text with the columns in the order of their names."""
    return F.to_json(F.struct(*sorted(columns)))


def add_if(*rules: tuple[Column, str]) -> Column:
    """The labels of all rules that hold, in order, each once."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(c, F.lit(label)) for c, label in rules])))


def first_match(*rules: tuple[Column, str], default: str | None = None) -> Column:
    """The label of the first rule that holds."""
    return F.coalesce(*[F.when(c, F.lit(label)) for c, label in rules], F.lit(default))


def split_set(c: Column, separator: str = ";") -> Column:
    """The distinct, trimmed, non-empty members of an encoded set."""
    return F.array_distinct(F.filter(F.transform(F.split(c, separator), lambda x: F.trim(x)), lambda x: x != ""))


def translate_set(c: Column, labels: dict[str, str], joiner: str = "；") -> Column:
    """An encoded set with its members replaced by labels where there are some."""
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]) if labels else F.create_map().cast("map<string,string>")
    return F.array_join(F.transform(split_set(c), lambda x: F.coalesce(F.try_element_at(table, x), x)), joiner)


def percent_diff(price: Column, reference: Column) -> Column:
    """How far a price is from its reference, in percent with one digit; null without a positive reference."""
    return F.when(reference > 0, F.bround((price - reference) / reference * 100, 1))


def price_status(price: Column, reference: Column) -> Column:
    return F.when(price.isNull() | reference.isNull() | (reference <= 0), "unknown").when(price == reference, "match").when(price > reference, "high").otherwise("low")


def price_symbol(status: Column) -> Column:
    return F.when(status == "match", "✓").when(status == "high", "↑").when(status == "low", "↓").otherwise("?")


def linear_cost(tokens_in: Column, tokens_out: Column, rate_in: float, rate_out: float) -> Column:
    """Cost of tokens at rates per million, to six digits; null if a count is missing."""
    return F.bround(tokens_in / 1e6 * rate_in + tokens_out / 1e6 * rate_out, 6)


def clamp(c: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def backoff_seconds(attempt: Column) -> Column:
    """Doubling from 15 seconds, at most 300."""
    return F.least(F.lit(300), (15 * F.pow(F.lit(2), F.least(attempt - 1, F.lit(5)))).cast("int"))


def plausible_price(c: Column, low: int = 500, high: int = 500_000) -> Column:
    return F.coalesce(c.try_cast("double").between(low, high), F.lit(False))


def one_inserted(longer: Column, shorter: Column) -> Column:
    """Whether one more character turns the shorter text into the longer one."""
    cut = lambda i: F.concat(F.substring(longer, F.lit(1), i - 1), F.substring(longer, i + 1, F.length(longer)))
    return (F.length(longer) == F.length(shorter) + 1) & F.exists(F.sequence(F.lit(1), F.length(longer)), lambda i: cut(i) == shorter)


def json_shape(c: Column, required: list[str], allowed: list[str] | None = None) -> Column:
    """Errors of a JSON object's keys: missing and extra ones, or that it is no object; empty if all is well."""
    keys = F.coalesce(F.json_object_keys(c), F.array().cast("array<string>"))
    missing = F.transform(F.array_except(F.array(*map(F.lit, required)), keys), lambda k: F.concat(F.lit("missing:"), k))
    extra = F.transform(F.array_except(keys, F.array(*map(F.lit, allowed or required))), lambda k: F.concat(F.lit("extra:"), k))
    return F.when(F.json_object_keys(c).isNull(), F.array(F.lit("not_an_object"))).otherwise(F.concat(missing, extra))

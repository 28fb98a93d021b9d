"""Text functions that need to go through a text in order, as folds over arrays of characters or tokens: no Python runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def characters(c: Column) -> Column:
    """The characters of a text, in order."""
    return F.filter(F.split(c, ""), lambda x: x != "")


def counting(first: int, last: Column) -> Column:
    """first, first + 1, ..., last; nothing if last comes before first."""
    return F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array().cast("array<int>"))


# Edit distance ----------------------------------------------------------------------------------------------------------


def _unlike(p: Column) -> Column:
    """p's arrays a and b without the elements that they begin with alike."""
    shorter = F.least(F.size(p["a"]), F.size(p["b"]))
    at = F.array_position(F.transform(F.sequence(F.lit(0), shorter), lambda i: (i == shorter) | (F.get(p["a"], i) != F.get(p["b"], i))), True).cast("int")
    rest = lambda x, n: F.slice(x, n, F.size(x) - n + 1)
    return let(at, lambda n: F.struct(rest(p["a"], n).alias("a"), rest(p["b"], n).alias("b")))


def osa_distance(left: Column, right: Column, limit: int = 3) -> Column:
    """Edits (insert, delete, replace, swap of neighbours, none inside another) from left to right, or limit + 1 if more.

    Equal beginnings and ends are left out, as they need no edit. A fold over what is left of left's characters carries two rows
    of the table of distances; a fold over right's makes the next. Null texts have no distance.
    """

    def distance(p: Column) -> Column:
        a, b = p["a"], p["b"]
        start = F.struct(F.array().cast("array<int>").alias("two"), F.sequence(F.lit(0), F.size(b)).alias("one"), F.lit("").alias("before"), F.lit(0).alias("i"))

        def row(s: Column, x: Column) -> Column:
            def cell(r: Column, j: Column) -> Column:
                y = F.get(b, j - 1)
                plain = F.least(F.get(s["one"], j) + 1, F.element_at(r, -1) + 1, F.get(s["one"], j - 1) + F.when(x == y, 0).otherwise(1))
                swapped = (s["i"] > 0) & (j > 1) & (x == F.get(b, j - 2)) & (s["before"] == y)
                return F.array_append(r, F.when(swapped, F.least(plain, F.get(s["two"], j - 2) + 1)).otherwise(plain))

            new = F.aggregate(counting(1, F.size(b)), F.array(s["i"] + 1), cell)
            return F.struct(s["one"].alias("two"), new.alias("one"), x.alias("before"), (s["i"] + 1).alias("i"))

        return F.aggregate(a, start, row, lambda s: F.least(F.element_at(s["one"], -1), F.lit(limit + 1)))

    def trimmed(p: Column) -> Column:
        reversed_ = lambda q: F.struct(F.reverse(q["a"]).alias("a"), F.reverse(q["b"]).alias("b"))
        return let(let(let(_unlike(p), reversed_), _unlike), lambda q: let(reversed_(q), distance))

    far = F.abs(F.length(left) - F.length(right)) > limit
    return F.when(far, limit + 1).when(left.isNotNull() & right.isNotNull(), let(F.struct(characters(left).alias("a"), characters(right).alias("b")), trimmed))


def deletions(c: Column, most: int) -> Column:
    """The text, and what is left of it with up to `most` characters deleted, each once.

    Two texts within `most` edits (a swap is one) have one of these in common.
    """
    out = level = F.array(c)
    for _ in range(most):
        shorter = F.transform(level, lambda t: F.transform(counting(1, F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t)))))
        level = F.array_distinct(F.flatten(shorter))
        out = F.concat(out, level)
    return F.array_distinct(out)


# JSON in prose ----------------------------------------------------------------------------------------------------------

#: What a text of JSON is read by: strings (the last may lack its end), single brackets, and runs of anything else.
_TOKENS = r'(?s)"(?:[^"\\]++|\\.)*+(?:"|\\?$)|[{}\[\]]|[^{}\[\]"]++|.'


def _tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(_TOKENS), F.lit(0))


def _object_length(c: Column) -> Column:
    """Length of the object that the text begins with, up to the brace that closes it outside strings; 0 if none does."""

    def read(s: Column, t: Column) -> Column:
        depth = s["depth"] + F.when(t == "{", 1).when(t == "}", -1).otherwise(0)
        at = s["at"] + F.length(t)
        ended = F.when((s["ended"] == 0) & (depth == 0), at).otherwise(s["ended"])
        return F.when(s["ended"] > 0, s).otherwise(F.struct(depth.alias("depth"), at.alias("at"), ended.alias("ended")))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("ended"))
    return F.aggregate(_tokens(c), start, read, lambda s: s["ended"])


def json_objects(c: Column) -> Column:
    """The outermost JSON objects in a prose, as canonical texts (keys in order, no blanks); those that don't parse, or have
    a key twice, are left out, and what is inside them is looked through. Null texts have none.

    From each brace on, a fold over strings and brackets finds the brace that closes it, and what lies between is parsed; the
    search goes on behind an object, or one character on if there was none.
    """
    nothing = F.array().cast("array<string>")

    def search(s: Column, _: Column) -> Column:
        def judge(b: Column) -> Column:
            def keep(o: Column) -> Column:
                missed = F.struct(F.substring(b["text"], F.lit(2), F.length(b["text"])).alias("rest"), s["found"].alias("found"))
                found = F.struct(F.substring(b["text"], b["n"] + 1, F.length(b["text"])).alias("rest"), F.array_append(s["found"], o).alias("found"))
                return F.when(o.isNull(), missed).otherwise(found)

            return let(F.when(b["n"] > 0, F.to_json(F.try_parse_json(F.substring(b["text"], F.lit(1), b["n"])))), keep)

        def measure(text: Column) -> Column:
            return let(F.struct(text.alias("text"), _object_length(text).alias("n")), judge)

        at = F.locate("{", s["rest"])
        done = F.struct(F.lit("").alias("rest"), s["found"].alias("found"))
        return F.when(at == 0, done).otherwise(let(F.substring(s["rest"], at, F.length(s["rest"])), measure))

    text = F.coalesce(c, F.lit(""))
    braces = F.length(text) - F.length(F.replace(text, F.lit("{"), F.lit("")))
    return F.aggregate(counting(1, braces), F.struct(text.alias("rest"), nothing.alias("found")), search, lambda s: s["found"])


def repair_json(c: Column) -> Column:
    """A JSON text without fences, comment lines and trailing commas, with a price cut off closed and its brackets closed.

    A price that ends behind its colon becomes an empty text; a text cut off gets its quote; then what is still open is closed,
    innermost first. Brackets inside strings don't count. Null stays null.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), r"^\s*```\w*\s*", ""), r"\s*```\s*$", "")
    lines = F.array_join(F.filter(F.split(bare, "\r?\n"), lambda x: ~F.ltrim(x, F.lit(" \t")).startswith("//")), "\n")

    def close(t: Column) -> Column:
        def read(stack: Column, token: Column) -> Column:
            popped = F.substring(stack, F.lit(2), F.length(stack))
            return F.when(token == "{", F.concat(F.lit("}"), stack)).when(token == "[", F.concat(F.lit("]"), stack)).when(token.isin("}", "]"), popped).otherwise(stack)

        def finish(tokens: Column) -> Column:
            last = F.coalesce(F.try_element_at(tokens, F.lit(-1)), F.lit(""))
            open_text = last.startswith('"') & ~last.rlike(r'(?s)^"(?:[^"\\]++|\\.)*+"$')
            value = F.when(t.rlike(r'"price"\s*:\s*$'), F.concat(t, F.lit('""'))).when(open_text, F.concat(t, F.lit('"'))).otherwise(F.regexp_replace(t, r",\s*$", ""))
            return F.concat(value, F.aggregate(tokens, F.lit(""), read))

        return let(_tokens(t), finish)

    return F.regexp_replace(let(lines, close), r",(\s*[}\]])", "$1")


def answer_json(c: Column, hints: list[str]) -> Column:
    """The JSON object that an answer gives: its last line that is one, else its last short brace group that is one and has one
    of the quoted keys of `hints`, else the inside of its last fenced block, if that is one; else null. As canonical text."""
    parsed = lambda x: F.when(F.trim(x).startswith("{"), F.to_json(F.try_parse_json(x)))
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x.startswith("{") & x.endswith("}"))
    groups = F.filter(F.regexp_extract_all(c, F.lit(r"(?s)\{.*?\}"), F.lit(0)), lambda x: F.exists(F.array(*map(F.lit, hints)), lambda h: x.contains(F.concat(F.lit('"'), h, F.lit('"')))))
    fenced = F.regexp_extract_all(c, F.lit(r"(?s)```(?:json)?\s*(\{.*?\})\s*```"), F.lit(1))
    last = lambda found: F.try_element_at(F.filter(F.transform(found, parsed), lambda x: x.isNotNull()), F.lit(-1))
    return F.coalesce(last(lines), last(groups), last(fenced))


# Loops ------------------------------------------------------------------------------------------------------------------

#: Fixed values of the reference: what counts as a token, and the sizes of chunks that a tail is tried for.
LOOP_TOKEN = "[A-Za-z0-9]+(?::[A-Za-z0-9]+)?|[一-鿿]{2,}"
LOOP_CHUNKS = (4, 5, 6, 8, 10, 12, 16, 20, 24, 32, 40)
_BLANK = " \t\n\x0b\x0c\r"


def watched_prose(c: Column, fields: tuple[str, ...] = ("narration", "desc")) -> Column:
    """What of a model's answer is prose: of a JSON object (fences aside) the first of the fields that has text, else what
    stands before a brace, else all. Null texts have none."""
    answer = F.try_parse_json(F.regexp_replace(F.coalesce(c, F.lit("")), "```(json)?", ""))
    is_object = F.schema_of_variant(answer).startswith("OBJECT")
    told = F.coalesce(*[F.nullif(F.try_variant_get(answer, f"$.{f}", "string"), F.lit("")) for f in fields], F.lit(""))
    before = F.trim(F.substring_index(F.coalesce(c, F.lit("")), "{", 1), F.lit(_BLANK))
    return F.when(F.coalesce(is_object, F.lit(False)), told).when(c.contains("{"), before).otherwise(F.coalesce(c, F.lit("")))


def loops(c: Column) -> Column:
    """Whether a prose loops. Null and empty ones don't.

    A token of 4 characters or more comes twelve times among the last 120; or the last 1,600 characters, white space left
    out, end with one chunk six times; or one of the last 15 lines of over 15 characters comes twice; or, in a text of over
    200 characters with two such lines, one of the windows of 30 characters at every 50th stands three times anywhere in
    the text without overlap. Windows are searched for one by one, so a text costs its square; of over 4,000 characters only
    one that has some 30 characters twice, which one pass over all its runs of 30 tells.
    """

    def judge(w: Column) -> Column:
        recent = F.filter(F.slice(F.reverse(F.regexp_extract_all(w, F.lit(LOOP_TOKEN), F.lit(0))), 1, 120), lambda t: F.length(t) >= 4)
        often = let(F.sort_array(recent), lambda r: F.exists(counting(12, F.size(r)), lambda i: F.get(r, i - 1) == F.get(r, i - 12)))
        compact = F.regexp_replace(w, r"\s+", "")
        ends = let(F.right(compact, F.lit(1600)), lambda t: F.exists(F.array(*map(F.lit, LOOP_CHUNKS)), lambda n: (F.length(t) >= 8 * n) & t.endswith(F.repeat(F.right(t, n), F.lit(6)))))
        long = F.filter(F.transform(F.split(w, "\n"), lambda x: F.trim(x, F.lit(_BLANK))), lambda x: F.length(x) > 15)
        twice = let(F.slice(F.reverse(long), 1, 15), lambda x: F.size(F.array_distinct(x)) < F.size(x))
        starts = F.when(F.length(w) > 200, F.sequence(F.lit(0), F.length(w) - 31, F.lit(50)))
        thrice = F.exists(starts, lambda i: let(F.substring(w, i + 1, F.lit(30)), lambda s: F.length(w) - F.length(F.replace(w, s, F.lit(""))) >= 90))
        runs = F.regexp_extract_all(w, F.lit("(?s)(?=(.{30}))"), F.lit(1))
        again = (F.length(w) <= 4000) | let(runs, lambda r: F.size(F.array_distinct(r)) < F.size(r))
        return often | ends | twice | ((F.size(long) >= 2) & again & F.coalesce(thrice, F.lit(False)))

    return let(F.coalesce(c, F.lit("")), judge)

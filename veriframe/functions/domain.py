"""Expressions over several columns or evidence arrays: resolution, normalisation, extraction and judgement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veriframe.functions import text as T
from veriframe.functions.folds import json_objects, let


def alias(c: Column, names: dict[str, str]) -> Column:
    """The value's canonical name where it has one, else the value."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(table, c), c)


def canonical_family(c: Column, sizes: list[str], series: list[str], legal: list[str], pro: str = "PRO") -> Column:
    """size-series(-PRO) from free text: the first listed size and series that occur; null unless it is a legal value."""
    t = F.upper(c)
    first = lambda words: F.coalesce(*[F.when(t.contains(w), F.lit(w)) for w in words])
    name = F.concat_ws("-", first(sizes), first(series), F.when(t.contains(pro), F.lit(pro)))
    return F.when(name.isin(*legal), name)


def resolve(values: list[Column], fallback: Column | None = None, unresolved: str = "unresolved") -> Column:
    """The one distinct value among all that are present; several make it unresolved, none falls back."""
    found = F.array_distinct(F.array_compact(F.array(*[T.clean(v) for v in values])))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0))).when(F.size(found) > 1, F.lit(unresolved)).otherwise(fallback if fallback is not None else F.lit(None))


def convert_script(c: Column, single: dict[str, str], phrases: dict[str, str]) -> Column:
    """Characters replaced one by one, then phrases in the given order."""
    out = F.translate(c, "".join(single), "".join(single.values()))
    for a, b in phrases.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def residual(c: Column, characters: str) -> Column:
    """Which of the characters are still in the text, each once, in order of appearance."""
    return F.array_distinct(F.filter(F.split(c, ""), lambda x: F.lit(characters).contains(x) & (x != "")))


def clean_stream(c: Column, phrases: list[str], punctuation: str = "，。、；：,.;: ") -> Column:
    """A streamed text without fixed phrases, and without punctuation at its head."""
    out = c
    for p in phrases:
        out = F.replace(out, F.lit(p), F.lit(""))
    return F.ltrim(out, F.lit(punctuation))


# Fixed values of the reference: what marks a monologue or a draft, where it ends, and what lines are no monologue.
MONOLOGUE = ["獨白：", "独白：", "獨白:", "独白:", "獨白", "独白", "自言自語：", "自言自语：", "自言自語", "自言自语"]
DRAFT = ["草稿：", "草稿:", "草稿"]
MONOLOGUE_ENDS = ["\nJSON", "JSON 結構", "JSON结构", "\n{", "view_type:", "view_type：", "```"]
LIST_MARKS = ["-", "*", "1.", "2.", "3.", "4.", "5.", "6.", "7.", "8.", "9.", "#", "【", "[", "(", "`"]
META_WORDS = ["用戶", "用户", "分析", "判斷", "判断", "分類", "分类", "提取", "構建", "构建", "確定", "确定", "最終檢查", "最终检查", "View Type", "Category", "Model:", "Price:", "Screen Status", "Quality Issue"]
SEEN_WORDS = ["我看到", "我看", "這台", "这台", "這張", "这张"]


def monologue(c: Column, least: int = 10, line_least: int = 15) -> Column:
    """The monologue in a model's reasoning: behind the first marker that has one of `least` characters or more behind it,
    markers of monologues before those of drafts; else the line nearest before the JSON that tells what is seen; else empty.

    A monologue ends where structure begins and with its line, and marks at its head go. Null texts have none.
    """
    blank = F.lit(" \t\n\x0b\x0c\r")
    strip = lambda x: F.trim(x, blank)

    def clean(x: Column) -> Column:
        for end in MONOLOGUE_ENDS:
            x = F.substring_index(x, end, 1)
        line = strip(F.substring_index(strip(x), "\n", 1))
        marks = F.array(*map(F.lit, [*DRAFT, *MONOLOGUE[:6]]))
        return F.aggregate(marks, line, lambda x, m: F.when(x.startswith(m), strip(F.substring(x, F.length(m) + 1, F.length(x)))).otherwise(x))

    def behind(t: Column) -> Column:
        marks = F.array(*map(F.lit, [*MONOLOGUE, *DRAFT]))
        told = F.transform(F.filter(marks, lambda m: t.contains(m)), lambda m: clean(F.substring(t, F.call_function("instr", t, m) + F.length(m), F.length(t))))
        return F.get(F.filter(told, lambda x: F.length(x) >= least), F.lit(0))

    def nearest(t: Column) -> Column:
        any_of = lambda x, words: F.exists(F.array(*map(F.lit, words)), lambda w: x.contains(w))
        lines = F.transform(F.split(F.substring_index(t, "\n{", 1), "\n"), lambda x, i: F.struct(F.call_function("instr", t, strip(x)).alias("at"), (-i).alias("i"), strip(x).alias("x")))
        fits = lambda x: (F.length(x) >= line_least) & ~F.exists(F.array(*map(F.lit, LIST_MARKS)), lambda m: x.startswith(m)) & ~any_of(x, META_WORDS) & any_of(x, SEEN_WORDS)
        return let(F.array_max(F.filter(lines, lambda s: fits(s["x"]))), lambda s: clean(s["x"]))

    return let(strip(F.coalesce(c, F.lit(""))), lambda t: F.coalesce(behind(t), nearest(t), F.lit("")))


# Fixed values of the reference: field names with a colon or equals sign, and phrases of instructions.
RAW_FIELDS = r"""(?i)["']?(?:view_type|category|model|price|quality_issue|screen_status|complete_screen_count|unique_main|label_ownership|followme_physical_evidence|guard_decision|raw_model_output)["']?\s*[:=]"""
INSTRUCTIONS = r"(?i)送出前(?:最後)?檢查|必須(?:填入|加入|逐項寫入)|禁止(?:輸出|說它)|不得(?:敘述|抄寫)|線索時禁止|followme_physical_evidence\s*不得|(?:最終|重新)?(?:校正|修正|更正)(?:後|結果|為|：|:)"


def narration_faults(c: Column) -> Column:
    """What a narration holds that is none: `raw_structure` (a fence before a bracket, a field with its sign, or any JSON object
    or array that parses) and `instruction_echo` (phrases of instructions). Null texts hold nothing."""
    arrays = F.exists(F.regexp_extract_all(c, F.lit(r"\[[^\[\]]*\]"), F.lit(0)), lambda x: F.try_parse_json(x).isNotNull())
    raw = c.rlike(r"(?i)```\s*(?:json)?\s*[\[{]") | c.rlike(RAW_FIELDS) | arrays | (F.size(json_objects(c)) > 0)
    return T.add_if((F.coalesce(raw, F.lit(False)), "raw_structure"), (F.coalesce(c.rlike(INSTRUCTIONS), F.lit(False)), "instruction_echo"))


def normalise_evidence(c: Column, valid: list[str], weak: list[str]) -> Column:
    """Evidence structs (cue, strength) with a valid cue, the first of each cue; weak cues are made weak."""
    kept = F.filter(c, lambda e: e["cue"].isin(*valid))
    once = F.filter(kept, lambda e, i: F.array_position(F.transform(kept, lambda x: x["cue"]), e["cue"]) == i + 1)
    return F.transform(once, lambda e: F.struct(e["cue"].alias("cue"), F.when(e["cue"].isin(*weak), "weak").otherwise(e["strength"]).alias("strength")))


def evidence_errors(c: Column, valid: list[str]) -> Column:
    """Labels of invalid and of repeated cues."""
    cues = F.transform(c, lambda e: e["cue"])
    bad = F.transform(F.filter(cues, lambda x: ~x.isin(*valid)), lambda x: F.concat(F.lit("invalid_cue:"), x))
    twice = F.when(F.size(F.array_distinct(cues)) < F.size(cues), F.array(F.lit("duplicate_cue"))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array_distinct(bad), twice)


def sufficient_evidence(c: Column, least: int = 2) -> Column:
    """Whether `least` distinct cues are strong."""
    return F.size(F.array_distinct(F.transform(F.filter(c, lambda e: e["strength"] == "strong"), lambda e: e["cue"]))) >= least


def fallback_fields(c: Column, catalog: list[str], token: str = "[A-Z][A-Z0-9]{7,}") -> Column:
    """Untrusted model and price from free text: a catalogue match, else the longest token; the most frequent price, first seen on a tie."""
    tokens = T.distinct_matches(F.upper(c), token)
    known = F.array_intersect(tokens, F.array(*map(F.lit, catalog)).cast("array<string>"))
    longest = F.array_max(F.transform(tokens, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("x"))))["x"]
    prices = F.regexp_extract_all(c, F.lit("(?<![0-9])[1-9][0-9]{3,4}(?![0-9])"), F.lit(0))
    ranked = F.transform(F.array_distinct(prices), lambda p, i: F.struct(F.size(F.filter(prices, lambda q: q == p)).alias("n"), (-i).alias("i"), p.alias("p")))
    return F.struct(F.coalesce(F.get(known, F.lit(0)), longest).alias("model"), F.array_max(ranked)["p"].alias("price"), F.lit(True).alias("requires_retry"))


def last_json_line(c: Column) -> Column:
    """The last line that is a JSON object."""
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x.startswith("{") & x.endswith("}"))
    return F.try_element_at(F.filter(lines, lambda x: F.json_object_keys(x).isNotNull()), F.lit(-1))


def merge_objects(found: Column, core: list[str], evidence: list[str], other: list[str], container: str = "evidence") -> Column:
    """One object of the JSON objects of an answer, as mode, reason and merged (values as texts); what is unclear is rejected.

    single_object: one object, whose `container`, if there, is taken apart; disjoint_core_evidence: one with core keys and at
    most one without, which share no key. Otherwise the mode is none or rejected, the reason says why, and merged is null.
    found: an array of JSON texts of objects without repeated keys, as `folds.json_objects` gives them.
    """
    texts = lambda names: F.array(*map(F.lit, names)).cast("array<string>")
    parsed = lambda c: F.from_json(c, "map<string,string>")
    listed = lambda label, names: F.concat(F.lit(label), F.array_join(F.array_sort(names), ","))
    some = lambda names: F.size(names) > 0
    over = lambda a, b: F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)
    nothing = F.create_map().cast("map<string,string>")
    maps = F.filter(F.transform(found, parsed), lambda m: m.isNotNull())

    one = F.get(maps, F.lit(0))
    holds = F.coalesce(F.array_contains(F.map_keys(one), container), F.lit(False))
    inner, outer = parsed(F.try_element_at(one, F.lit(container))), F.map_filter(one, lambda k, _: k != container)
    inner_keys, outer_keys = F.map_keys(F.coalesce(inner, nothing)), F.map_keys(outer)
    strange = F.array_except(inner_keys, texts(evidence))
    twice = F.array_intersect(outer_keys, inner_keys)
    unknown = F.array_except(outer_keys, texts([*core, *evidence, *other]))
    single = (
        F.when(holds & inner.isNull(), "evidence_container_not_object")
        .when(some(strange), listed("evidence_container_unknown_keys:", strange))
        .when(some(twice), listed("duplicate_nested_evidence_keys:", twice))
        .when(some(unknown), listed("unknown_keys:", unknown))
    )

    has_core = lambda m: F.arrays_overlap(F.map_keys(m), texts(core))
    cores, rest = F.filter(maps, has_core), F.filter(maps, lambda m: ~has_core(m))
    main, extra = F.get(cores, F.lit(0)), F.coalesce(F.get(rest, F.lit(0)), nothing)
    clear = (F.size(cores) == 1) & (F.size(rest) <= 1) & ~F.exists(rest, lambda m: F.size(m) == 0)
    several = (
        F.when(~clear, "multiple_core_or_unknown_object")
        .when(some(F.array_except(F.map_keys(extra), texts([*evidence, *other]))), "evidence_object_has_unknown_keys")
        .when(F.arrays_overlap(F.map_keys(main), F.map_keys(extra)), "duplicate_core_evidence_keys")
    )

    n = F.coalesce(F.size(maps), F.lit(0))
    none, alone = n <= 0, n == 1
    reason = F.when(none, "no_valid_json_object").when(alone, single).otherwise(several)
    mode = F.when(none, "none").when(reason.isNotNull(), "rejected").when(alone, "single_object").otherwise("disjoint_core_evidence")
    merged = F.when(reason.isNull(), F.when(alone, over(outer, F.coalesce(inner, nothing))).otherwise(over(main, extra)))
    return F.struct(mode.alias("mode"), F.coalesce(reason, F.lit("")).alias("reason"), merged.alias("merged"))


def shape_error(c: Column, types: dict[str, list[str]], id_key: str, expected: Column) -> Column:
    """The first error of a JSON answer, else an empty text: no object, keys missing or extra, another id, a value's type.

    types: for each required key the variant types that its value may have (STRING, BIGINT, DOUBLE, DECIMAL, BOOLEAN, ARRAY,
    OBJECT, or VOID for null). The id is compared as text without white space around it; an empty one is missing.
    """
    keys = F.json_object_keys(c)
    names = F.array(*map(F.lit, types)).cast("array<string>")
    missing, extra = F.array_sort(F.array_except(names, keys)), F.array_sort(F.array_except(keys, names))
    given = F.trim(F.coalesce(F.get_json_object(c, f"$.{id_key}"), F.lit("")))
    value = F.try_parse_json(c)
    error = F.when(keys.isNull() | value.isNull(), "not_object").when(F.size(missing) > 0, F.concat(F.lit("missing:"), F.array_join(missing, ",")))
    error = error.when(F.size(extra) > 0, F.concat(F.lit("extra:"), F.array_join(extra, ","))).when(given == "", f"{id_key}_missing")
    error = error.when(~given.eqNullSafe(F.trim(expected)), f"{id_key}_mismatch")
    for key, allowed in types.items():
        kind = F.regexp_extract(F.schema_of_variant(F.try_variant_get(value, f"$.{key}", "variant")), "^[A-Z]+", 0)
        error = error.when(~F.coalesce(kind.isin(*allowed), F.lit(False)), f"{key}_invalid")
    return error.otherwise("")


def judge_fields(actual: dict[str, Column], expected: dict[str, Column]) -> Column:
    """Names of the fields whose value is not what was expected; a null expectation asks for nothing."""
    return T.add_if(*[(expected[f].isNotNull() & ~expected[f].eqNullSafe(actual[f]), f) for f in expected])


def receipt_trusted(modified: Column, confirmed: Column, same_content: Column, seconds: int = 2) -> Column:
    """A receipt holds unless the source changed more than `seconds` after it, and then only for the same content."""
    late = modified > confirmed + F.make_dt_interval(secs=F.lit(seconds))
    return F.coalesce(~late | same_content, F.lit(False))


def missing_ratio(model: Column, price: Column, single: Column) -> Column:
    """Share of single rows without model and price; an aggregate, 1 if there are no single rows."""
    n = F.count_if(single)
    return F.when(n == 0, 1.0).otherwise(F.count_if(single & ~T.present(model) & ~T.present(price)) / n)

"""Three passes over one thing, settled in one plan: who may vote, which rule of an ordered list decides, and a row-level transaction.

A key's passes become one array of structs, so votes, rules, supporting passes, invariants and rollback are expressions over
one row: a single shuffle by key. Only the last three passes of a key are taken, so the arrays are bounded; a window that slides
over the sorted passes gathers them, so that a task holds little more than its one sort does.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe.functions import text as T
from veriframe.functions.folds import let
from veriframe.operators import relational as R


@dataclass(frozen=True)
class Rule:
    """What a rule decides, the buckets whose passes support it, and when it holds: a condition over the buckets' counts
    (`n_<bucket>`), or, without one, whether the key's flags have its name."""

    name: str
    view: str
    support: tuple[str, ...]
    when: str | None = None


# Fixed values of the reference: names of the rules and of the outcomes, in the order in which rules are tried.
SINGLE, DISTANT = "單機", "遠景"
RULES = [
    Rule("three_pass_cross_photo_suspicion_cleared", SINGLE, ("usable",)),
    Rule("two_bound_pass_consensus_discarded_unbound_third", SINGLE, ("prior_bound",)),
    Rule("two_current_bound_owned_identity_tail_after_consumed_cap", SINGLE, ("winning_pair",)),
    Rule("three_pass_same_card_raw_field_consensus", SINGLE, ("usable",)),
    Rule("two_pass_edge_cut_identity_consensus", SINGLE, ("usable",)),
    Rule("two_pass_non_followme_identity_consensus", SINGLE, ("winning_pair",)),
    Rule("two_pass_unique_owned_identity_consensus", SINGLE, ("winning_pair",)),
    Rule("two_pass_followme_physical_consensus", SINGLE, ("family_geometry",)),
    Rule("two_pass_narrated_followme_fixture_consensus", SINGLE, ("narrated_fixture",)),
    Rule("three_pass_mixed_wide_distant_consensus", DISTANT, ("usable",)),
    Rule("three_pass_wide_scene_structural_consensus", DISTANT, ("usable",)),
    Rule("two_wide_geometry_votes_veto_single_identity_outlier", DISTANT, ("identity_free_wide",)),
    Rule("three_pass_zero_screen_scene_consensus", DISTANT, ("zero_screen",)),
    Rule("distant_structural_veto_over_wide_geometry_single_votes", DISTANT, ("usable",)),
    Rule("wide_scene_identity_conflict_distant_veto", DISTANT, ("usable",)),
    Rule("two_pass_identity_free_single_consensus", SINGLE, ("identity_free_single",)),
    Rule("three_pass_single_subject_consensus", SINGLE, ("usable",)),
    Rule("three_pass_subthree_single_content_closure", SINGLE, ("usable",)),
    Rule("two_pass_followme_physical_consensus", SINGLE, ("family",), "n_family >= 2 AND n_family_geometry >= 1 AND n_counterevidence = 0"),
    Rule("distant_structural_veto_over_two_weak_wide_single_votes", DISTANT, ("multi_screen", "weak_wide"), "n_multi_screen >= 1 AND n_weak_wide >= 2"),
    Rule("two_pass_edge_cut_frame_consensus", SINGLE, ("edge_cut",), "n_edge_cut >= 2"),
    Rule("two_pass_no_complete_screen_scene_consensus", DISTANT, ("no_screen",), "n_no_screen >= 2"),
    Rule("two_pass_distant_structural_consensus", DISTANT, ("multi_screen",), "n_multi_screen >= 2"),
    Rule("two_pass_distant_scene_consensus", DISTANT, ("distant",), "n_distant >= 2"),
    Rule("three_pass_complete_screen_count_distant_authority", DISTANT, ("usable",)),
    Rule("two_wide_narration_votes_distant_authority", DISTANT, ("usable",)),
    Rule("two_pass_single_view_consensus", SINGLE, ("single",), "n_single >= 2"),
    Rule("three_pass_subthree_distant_conflict_conservative_single", SINGLE, ("usable",)),
]
MISSING = "three_pass_view_majority_missing"
NO_SCREEN_RULES = ("two_pass_no_complete_screen_scene_consensus", "three_pass_zero_screen_scene_consensus")
UNHEALTHY, OTHER_IMAGE = "three_healthy_bound_passes_required", "three_pass_input_hash_mismatch"
BLOCKED, ERASED = "repeated_identity_pair_blocked_by_narration_conflict", "adjudication_repeated_identity_pair_erased_or_changed"
#: Health reasons that may stand: on a distant view the first alone; for integrity alone these three, or just the last.
LOCAL_CONFLICT = ("structured_narration_followme_conflict",)
FAMILY_CONFLICTS = ("distant_followme_strong_evidence_conflict", "structured_narration_followme_conflict", "structured_authority_material_conflict:model")


def usable(healthy: Column, reasons: Column, view: Column, local_distant: bool = False) -> Column:
    """Whether a pass may vote by its health: healthy, or, if local_distant, a distant one with none but the local conflict."""
    yes = F.coalesce(healthy, F.lit(False))
    allowed = F.array(*map(F.lit, LOCAL_CONFLICT))
    local = (view == DISTANT) & (F.size(reasons) > 0) & (F.size(F.array_except(reasons, allowed)) == 0)
    return yes | F.coalesce(local, F.lit(False)) if local_distant else yes


def intact(healthy: Column, reasons: Column, local_family: bool = False) -> Column:
    """Whether a pass proves its request and image, whatever it claims: healthy, or in conflict on the model alone, or, if
    local_family, with some of the family's conflicts and no other reason."""
    yes = F.coalesce(healthy, F.lit(False)) | F.coalesce(F.array_distinct(reasons) == F.array(F.lit(FAMILY_CONFLICTS[2])), F.lit(False))
    known = (F.size(reasons) > 0) & (F.size(F.array_except(reasons, F.array(*map(F.lit, FAMILY_CONFLICTS)))) == 0)
    return yes | F.coalesce(known, F.lit(False)) if local_family else yes


def buckets(view: Column, screens: Column, unique_main: Column, owner: Column, weak_wide: Column, edge_cut: Column, family: Column) -> dict[str, Column]:
    """The buckets of a pass, as far as they follow from its own fields; it may fall into several."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    far = yes((view == DISTANT) & ((screens == 0) | (screens >= 3)) & ~unique_main & ~owner.eqNullSafe(F.lit("matched")))
    one = yes(view == SINGLE)
    return {
        "single": one & ~yes(weak_wide), "edge_cut": one & yes(edge_cut), "weak_wide": one & yes(weak_wide), "family": yes(family),
        "distant": far, "no_screen": far & (screens == 0), "multi_screen": far & (screens != 0),
    }


def decide_view(passes: DataFrame, key: str, attempt: str, bucket_of: dict[str, Column], flags: str, keep: list[str], rules: list[Rule] = RULES, order: Sequence[str] = ()) -> DataFrame:
    """key, passes, rule, view, support: the first rule that holds for the last three passes of a key, and those that support it.

    bucket_of: for each bucket the condition over a pass; buckets that rules name and it lacks are empty, `usable` is all.
    flags: an array of names of rules that a key's other evidence has proved, the same in all its passes. Columns in keep stay
    in the passes' structs. Without a rule that holds, rule is null and support empty. order: columns that order a key's passes
    as attempt does; where a window has already sorted each key by them, descending, nothing is sorted again.
    """
    names = sorted({b for r in rules for b in r.support} | set(bucket_of) | {"family_geometry", "counterevidence"})
    full = {b: F.coalesce(bucket_of[b], F.lit(False)) if b in bucket_of else F.lit(b == "usable") for b in names}
    among = lambda *of: lambda p: reduce(lambda a, b: a | b, [p["in"][b] for b in of])
    fields = [F.col(attempt).alias("attempt"), *[F.col(c) for c in keep if c != "attempt"], F.struct(*[c.alias(b) for b, c in full.items()]).alias("in")]
    order = list(order) or [attempt]
    down = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    three = down.rowsBetween(0, 2)
    last = R.last_n(passes, [key], order, 3)
    run = last.select(key, F.collect_list(F.struct(*fields)).over(three).alias("passes"), F.max(flags).over(three).alias("_flags"), F.row_number().over(down).alias("_r"))
    held = run.filter(F.col("_r") == 1).select(key, F.array_sort("passes").alias("passes"), "_flags")
    held = held.select("*", *[F.size(F.filter("passes", among(b))).alias(f"n_{b}") for b in names])
    holds = [F.array_contains("_flags", r.name) if r.when is None else F.expr(r.when) for r in rules]
    number = F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), i) for i, c in enumerate(holds)])
    table = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.view).alias("view")) for r in rules])
    supports = [F.when(F.col("_rule") == i, F.filter("passes", among(*r.support))) for i, r in enumerate(rules)]
    decided = held.withColumn("_rule", number)
    none = F.filter("passes", lambda p: F.lit(False))
    return decided.select(key, "passes", F.get(table, F.col("_rule"))["rule"].alias("rule"), F.get(table, F.col("_rule"))["view"].alias("view"), F.coalesce(*supports, none).alias("support"))


def finalise(passes: DataFrame, key: str, attempt: str, bucket_of: dict[str, Column], flags: str, healthy: Column, digest: str, order: Sequence[str] = ()) -> DataFrame:
    """key, verified, reason, rule, view, model, price, screens, cues, support: three passes of a key settled, or the reason why not.

    passes has view, model, price, screens, owner, safe (whether a pass's fields may be published) and cues (an array of structs
    of cue and strength). Three healthy passes of one image are needed. The rule decides the view and who supports it. A pair of
    model and price that owned passes repeat must not be unsafe. A single thing takes the pair on which two safe, owned
    supporting passes agree, if it is the only one; a distant one has none, and as many screens as the fewest seen, three
    at least, or none by rules of that kind. Cues are those of the supporting passes, the first of each. All this is a trial
    row: if owned passes repeat one pair and no other, the trial must have it, else the key keeps nothing of it. order: as in
    `decide_view`.
    """
    marked = passes.withColumn("_healthy", F.coalesce(healthy, F.lit(False)))
    keep = ["view", "model", "price", "screens", "owner", "safe", "cues", "_healthy", digest]
    decided = decide_view(marked, key, attempt, bucket_of, flags, keep, order=order)
    well = F.size(F.filter("passes", lambda p: p["_healthy"])) == 3
    images = F.array_distinct(F.transform("passes", lambda p: F.coalesce(F.lower(p[digest]), F.lit(""))))
    one_image = (F.size(images) == 1) & ~F.array_contains(images, "")

    def pairs(of: str, safe: bool) -> Column:
        counted = lambda p: F.coalesce((p["owner"] == "matched") & p["model"].isNotNull() & p["price"].isNotNull() & (p["safe"] | F.lit(not safe)), F.lit(False))
        return F.transform(F.filter(of, counted), lambda p: F.struct(p["model"].alias("model"), p["price"].alias("price")))

    repeated = lambda c: let(c, lambda a: F.filter(F.array_distinct(a), lambda x: F.size(F.filter(a, lambda y: y == x)) >= 2))
    blocked = F.size(F.array_except(repeated(pairs("support", False)), repeated(pairs("support", True)))) > 0
    agreed = repeated(pairs("support", True))
    pair = F.when((F.col("view") == SINGLE) & (F.size(agreed) == 1), F.get(agreed, F.lit(0)))
    fewest = F.array_min(F.transform("support", lambda p: p["screens"]))
    screens = F.when(F.col("view") == DISTANT, F.when(F.col("rule").isin(*NO_SCREEN_RULES), 0).otherwise(F.greatest(F.lit(3), F.coalesce(fewest, F.lit(3))))).otherwise(F.array_max(F.transform("support", lambda p: p["screens"])))
    cues = F.flatten(F.transform("support", lambda p: F.coalesce(p["cues"], F.array())))
    first = let(cues, lambda a: F.filter(a, lambda c, i: F.array_position(F.transform(a, lambda x: x["cue"]), c["cue"]) == i + 1))
    trial = F.struct(F.col("view").alias("view"), pair["model"].alias("model"), pair["price"].alias("price"), screens.alias("screens"), first.alias("cues"), F.transform("support", lambda p: p["attempt"]).alias("support"))
    tried = decided.withColumn("_trial", trial)

    seen = pairs("passes", False)
    published = F.struct(F.col("_trial.model").alias("model"), F.col("_trial.price").alias("price"))
    erased = (F.size(F.array_distinct(seen)) == 1) & (F.size(repeated(seen)) == 1) & ~F.array_contains(repeated(seen), published)
    reason = T.first_match((~well, UNHEALTHY), (~one_image, OTHER_IMAGE), (F.col("rule").isNull(), MISSING), ((F.col("view") == SINGLE) & blocked, BLOCKED), (erased, ERASED), default="")
    out = tried.withColumn("reason", reason)
    ok = F.col("reason") == ""
    return out.select(key, ok.alias("verified"), "reason", F.when(ok, F.col("rule")).alias("rule"), *[F.when(ok, F.col(f"_trial.{c}")).alias(c) for c in ("view", "model", "price", "screens", "cues", "support")])


# Retry reasons ----------------------------------------------------------------------------------------------------------

# Fixed values of the reference: its reasons for another pass, in the order in which it lists them, and when each holds, over
# the columns that `retry_reasons` documents.
RETRY_REASONS = [
    ("evidence_thinking_conflict", "view = '遠景' AND valid AND NOT wide_resolved AND hint <> '遠景' AND ((screens <> 0 AND NOT narrated_count) OR NOT narrated_no_main)"),
    ("處理失敗", "view = '失敗'"),
    ("官網未收錄型號需三輪獨立照片證據一致", "unlisted AND NOT photo_consensus"),
    ("價牌短型號唯一補全需第二輪獨立確認", "prefix_completed AND NOT same_pair_before"),
    ("型號未通過正式清單驗證", "model_invalid"),
    ("型號表未載入，屬系統設定錯誤", "catalog_missing"),
    ("價格欄位互相衝突", "price_conflict AND NOT (family_terminal AND price IS NULL)"),
    ("品牌敘述與正式型號衝突", "brand_conflict"),
    ("模型未回傳可信結構化結果", "unstructured"),
    ("人工確認高風險原圖必須完成三輪獨立複核", "known_risk AND attempt < most"),
    ("人工確認高風險原圖與模型的視角、完整台數或價牌證據衝突，不得自動驗證", "known_risk AND attempt >= most AND risk_conflict"),
    ("跨照片重複核心不得以兩輪相同洗白，必須完成第三輪無記憶複核", "cross_photo AND attempt < most"),
    ("跨照片污染疑慮經三輪仍不得自動驗證，需人工或異構模型複核", "cross_photo AND attempt >= most AND NOT cross_photo_cleared"),
    ("本輪出現承接前輪答案的污染語句", "attempt >= 2 AND refers_back"),
    ("結構為單機但敘述明確判為遠景", "view = '單機' AND narrated_distant"),
    ("寬廣多螢幕陳列缺少可歸屬的單機身分證據", "hint <> '近景' AND weak_wide"),
    ("標籤歸屬與敘述衝突", "owner = 'matched' AND owner_denied"),
    ("敘述借用了與主角型號不相容的背景產品系列", "family_borrowed"),
    ("寬景唯一主角型號跨輪不一致，需完成有界複核", "screens >= 3 AND strong_owned AND other_model_before"),
    ("2026 同圖獨立輪次價格不一致需完成第三輪定案", "current_year AND view = '單機' AND other_price_before"),
    ("敘述明確只有一台完整螢幕，結構完整台數必須為1", "narrated_one AND screens <> 1 AND NOT safe_two"),
    ("敘述指出中央一台且左右鄰機被邊界裁切，完整台數不得填三台以上", "edge_cut"),
    ("遠景不應帶型號或價格", "view = '遠景' AND (model IS NOT NULL OR price IS NOT NULL)"),
    ("遠景缺少三台以上完整入鏡證據", "view = '遠景' AND attempt >= most AND NOT valid AND NOT narrated_three"),
    ("遠景缺少無法鎖定唯一主角規格/價格的證據", "view = '遠景' AND attempt >= most AND NOT valid AND NOT narrated_no_main"),
    ("2026 單機缺型號", "view = '單機' AND current_year AND model IS NULL AND NOT family_terminal"),
    ("2026 單機缺價格", "view = '單機' AND current_year AND price IS NULL AND NOT family_terminal"),
    ("單機結果與三台以上完整陳列衝突", "view = '單機' AND narrated_three AND narrated_no_main AND NOT family_physical"),
    ("寬景中的 FollowMe 實體需第二輪獨立確認", "view = '單機' AND hint <> '近景' AND screens >= 3 AND family_physical AND attempt = 1 AND NOT family_terminal"),
    ("寬景單機候選需第二輪確認是否為 FollowMe", "view = '單機' AND hint <> '近景' AND screens >= 3 AND NOT family_physical AND NOT wide_resolved AND NOT strong_owned AND attempt = 1 AND family_possible"),
    ("沒有 FollowMe 實體證據的三台以上完整螢幕應定案遠景", "view = '單機' AND hint <> '近景' AND screens >= 3 AND NOT family_physical AND NOT wide_resolved AND NOT strong_owned AND NOT (attempt = 1 AND family_possible)"),
    ("FollowMe 缺少同一實機的物理支架證據", "family_model AND NOT family_physical AND NOT family_excluded"),
    ("2026 FollowMe 各輪型號與價格不一致，不得自動驗證", "current_year AND attempt > 1 AND (family_model OR family_physical) AND NOT family_excluded AND NOT family_consistent"),
]
QUALITY_FINE = ("無", "正常", "None", "null", "")
QUALITY_REASONS = {"遠景": "遠景與畫質標記需再確認:", "單機": "單機仍有品質疑慮:"}
NO_DISTANT_CONSENSUS = "三輪遠景判斷未達一致"
#: The columns that conditions name: booleans, of which null counts as false, and others.
RETRY_FLAGS = (
    "valid", "wide_resolved", "narrated_count", "narrated_no_main", "unlisted", "photo_consensus", "prefix_completed", "same_pair_before", "model_invalid", "catalog_missing", "price_conflict", "family_terminal",
    "brand_conflict", "unstructured", "known_risk", "risk_conflict", "cross_photo", "cross_photo_cleared", "refers_back", "narrated_distant", "weak_wide", "owner_denied", "family_borrowed", "strong_owned", "other_model_before",
    "current_year", "other_price_before", "narrated_one", "safe_two", "edge_cut", "narrated_three", "family_physical", "family_possible", "family_model", "family_excluded", "family_consistent",
)


def retry_reasons(passes: DataFrame, key: str, attempt: str, most: int = 3) -> DataFrame:
    """passes with `reasons` and `decision`: retry (some reason, attempts left), unresolved (none left) or verified.

    Columns: view, model, price, quality, hint, owner (texts, model and price null if there is none), screens, contract_reasons
    (an array, of a pass that is not valid), and those of RETRY_FLAGS that there are; others count as false. A distant pass at
    the last attempt without any reason must follow on distant ones alone, or it is unresolved.
    """
    flags = {f: F.coalesce(F.col(f), F.lit(False)) if f in passes.columns else F.lit(False) for f in RETRY_FLAGS}
    seen = passes.withColumns(flags | {"attempt": F.col(attempt), "most": F.lit(most), "hint": F.coalesce("hint", F.lit("")), "quality": F.coalesce("quality", F.lit(""))})
    listed = F.array_compact(F.array(*[F.when(F.coalesce(F.expr(when), F.lit(False)), F.lit(reason)) for reason, when in RETRY_REASONS]))
    doubt = F.coalesce(*[F.when((F.col("view") == v) & ~F.col("quality").isin(*QUALITY_FINE), F.concat(F.lit(label), "quality")) for v, label in QUALITY_REASONS.items()])
    contract = F.when(~F.col("valid"), F.coalesce("contract_reasons", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    before = Window.partitionBy(key).orderBy(attempt).rowsBetween(1 - most, 0)
    alone = (F.count_if(F.col("view") == DISTANT).over(before) < most) & (F.col("view") == DISTANT) & (F.col("attempt") >= most) & ~F.col("wide_resolved")
    found = seen.withColumn("_found", F.array_distinct(F.concat(contract, listed, F.array_compact(F.array(doubt))))).withColumn("_alone", alone)
    reasons = F.when((F.size("_found") == 0) & F.col("_alone"), F.array(F.lit(NO_DISTANT_CONSENSUS))).otherwise(F.col("_found"))
    out = found.withColumn("reasons", reasons)
    decision = F.when((F.size("reasons") > 0) & (F.col("attempt") < most), "retry").when((F.size("reasons") > 0) | ~F.col("valid"), "unresolved").otherwise("verified")
    return out.select(*[F.col(c) for c in passes.columns if c != "reasons"], "reasons", decision.alias("decision"))


# Benchmarks -------------------------------------------------------------------------------------------------------------


def dangers(tags: Column, expected_view: Column, expected_model: Column, view: Column, model: Column) -> Column:
    """The classes of dangerous errors that a prediction falls into, by its case's tags: a distant view taken for another, a
    family's unit taken for a distant view, a model made up. No prediction of a field is no error of this kind."""
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    tagged = lambda *t: F.arrays_overlap(tags, F.array(*map(F.lit, t)))
    rules = [
        (tagged("distant_view") & given(view) & ~view.eqNullSafe(expected_view), "distant_view_misclassification"),
        (tagged("followme", "followme_pro") & view.isin(DISTANT, "distant_view"), "followme_misclassification"),
        (tagged("hallucination_guard") & given(model) & ~model.eqNullSafe(expected_model), "model_hallucination"),
    ]
    return T.add_if(*[(F.coalesce(c, F.lit(False)), name) for c, name in rules])

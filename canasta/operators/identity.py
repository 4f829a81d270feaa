"""Is a listing the same kind of product as the target? Rules over word sets, evaluated on candidate pairs.

Names are analysed once per target and once per listing (`target_features`, `listing_features`); a pair then only compares
short arrays, so the rules are one narrow projection after the candidate join.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canasta.functions import quantity as Q
from canasta.functions import text as X
from canasta.functions.money import choose_price, fixed, unit_price
from canasta.functions.text import canonical_word, let, one_of, words
from canasta.operators.skew import HOT_ROWS, attach, cut, spread
from canasta.settings import PriceSettings
from canasta.vocabulary import (ALCOHOL_EXCUSED, ALCOHOL_FREE, BAKERY_FAMILIES, FRESH_FAMILIES, LATEST_HEAD_POSITION,
                                RAW_MEAT_LINES, SPANISH, Vocabulary, WEIGHED_NEUTRAL_FAMILIES)


def _none() -> Column:
    return F.array().cast("array<string>")


def _by_head(head: Column, table: dict) -> Column:
    out = _none()
    for family, items in table.items():
        out = F.when(head == family, words(items)).otherwise(out)
    return out


def _next_words(title: Column, marks: list[str], start: int = 0) -> Column:
    """Canonical form of the word after each of `marks`."""
    def following(w: Column, i: Column) -> Column:
        return F.when(one_of(w, marks) & (i >= start) & (i + 1 < F.size(title)), canonical_word(F.get(title, i + 1)))
    return F.array_compact(F.transform(title, following))


@lru_cache(maxsize=4)
def word_classes(v: Vocabulary) -> dict[str, tuple[int, list]]:
    """Classes of words as (bit, words). A word's classes are one number; the rules of a pair compare numbers."""
    lists = {c: getattr(v, c) for c in ("non_food", "pets", "alcohol", "derived", "speciality", "prepared", "deli", "processed", "fresh_signs", "flavors", "canned", "form")}
    lists |= {"alcohol_free": ALCOHOL_FREE, **{f"group{i}": g for i, g in enumerate(v.modifier_groups)}}
    return {name: (1 << i, items) for i, (name, items) in enumerate(lists.items())}


def _mask_of(word: str, v: Vocabulary) -> int:
    return sum(bit for bit, items in word_classes(v).values() if word in items)


def class_marks(tokens: Column, v: Vocabulary) -> Column:
    """The words that are in a class, with the number of their classes."""
    def mark(w: Column) -> Column:
        bits = [F.when(one_of(w, items), F.lit(bit).cast("long")).otherwise(F.lit(0).cast("long")) for bit, items in word_classes(v).values()]
        return F.struct(w.alias("t"), reduce(Column.bitwiseOR, bits).alias("m"))
    return F.filter(F.transform(F.array_distinct(tokens), mark), lambda e: e["m"] != 0)


def _mask(marks: Column) -> Column:
    return F.aggregate(marks, F.lit(0).cast("long"), lambda a, e: a.bitwiseOR(e["m"]))


def _has(mask: str, name: str, v: Vocabulary) -> Column:
    return F.col(mask).bitwiseAND(F.lit(word_classes(v)[name][0]).cast("long")) != 0


def _of_class(marks: str, name: str, v: Vocabulary) -> Column:
    bit = F.lit(word_classes(v)[name][0]).cast("long")
    return F.transform(F.filter(marks, lambda e: e["m"].bitwiseAND(bit) != 0), lambda e: e["t"])


@lru_cache(maxsize=4)
def _target_columns(v: Vocabulary) -> list[dict[str, Column]]:
    """The analysis of catalogue names in stages; each stage reads columns of the earlier ones."""
    ctx, name = F.col("context"), F.col("name")
    blob = F.concat_ws(" ", "context.line", "context.family", "context.description", "context.grp", "context.category")
    allows = [F.when(F.array_contains("t_all", word), words(items)).otherwise(_none()) for word, items in v.target_allows.items()]
    head = F.col("t_head")
    food = F.when(F.col("t_category") != "", F.col("t_category") != "no alimento").otherwise(~F.arrays_overlap("t_all", words(v.non_food)))
    purpose = F.array_union(_next_words(F.col("t_words"), ["para", "con"]), F.when(
        one_of(F.col("t_family"), BAKERY_FAMILIES), _next_words(F.col("t_words"), ["de"], 1)).otherwise(_none()))
    subtypes = _by_head(head, v.family_subtypes)
    return [
        {"t_tokens": X.semantic_tokens(name, v), "t_words": X.title_words(X.drop_parens(name)), "t_variety": X.is_variety(name, v),
         "t_line": X.norm_text(ctx["line"]), "t_family": X.norm_text(ctx["family"]), "t_category": X.norm_text(ctx["category"]),
         "t_size": Q.parse_quantity(name), "t_count": Q.target_count(name), "t_dims": Q.dimensions(name), "t_kind": Q.quantity_kind(name)},
        {"t_mods": X.context_modifiers(F.col("t_tokens"), blob, v)},
        {"t_req": X.required_tokens(F.col("t_tokens"), F.col("t_mods"), F.col("t_family"), v), "t_all": F.array_union("t_tokens", "t_mods"),
         "t_basis": Q.quantity_basis(F.col("t_count.n"), F.col("t_size.total_kg"), ctx["category"])},
        {"t_eff": X.effective_required(F.col("t_req"), v), "t_head": F.get("t_req", F.lit(0)), "t_all": reduce(F.array_union, allows, F.col("t_all"))},
        {"t_food": food, "t_members": _by_head(head, v.members), "t_forbidden": _by_head(head, v.family_forbidden),
         "t_generic": _by_head(head, v.generic_forbidden), "t_purpose": F.array_intersect(purpose, F.col("t_eff")),
         "t_subtypes": F.when(F.col("t_variety"), F.array_except(subtypes, words(["saborizado", "saborizada"]))).otherwise(subtypes),
         "t_canned": F.arrays_overlap("t_words", words(v.canned)),
         "t_surface": X.surface_words(name, F.col("t_req"), v), "t_marks": class_marks(F.col("t_all"), v)},
        {"t_mask": _mask(F.col("t_marks")), "t_flavors": _of_class("t_marks", "flavors", v)},
        {"t_search": X.search_queries(F.col("t_req"), F.col("t_surface"), F.col("t_eff"), v)},
    ]


def _per_text(rows: DataFrame, inputs: list[Column], analyse: Callable[[DataFrame], DataFrame], hot_rows: int) -> DataFrame:
    """`rows` with what `analyse` adds to the texts that `inputs` name. Each distinct text is analysed once, however many rows show it, and the
    result is written to the shared folder. A map is compared by its entries; a text that is NULL is a text of its own."""
    kinds = {c.name: c.dataType for c in rows.select(*inputs).schema.fields}
    maps = [c for c, kind in kinds.items() if isinstance(kind, T.MapType)]
    key = F.struct(*[F.map_entries(c).alias(c) if c in maps else F.col(c) for c in kinds]).alias("_text")
    keyed = rows.withColumn("_text", key)
    texts = spread(cut(keyed.groupBy("_text").agg(F.count(F.lit(1)).alias("_n")), "texts"))
    texts = texts.select("_text", "_n", *[(F.map_from_entries(f"_text.{c}") if c in maps else F.col(f"_text.{c}")).alias(c) for c in kinds])
    done = analyse(texts)
    changed = [c for c in done.columns if c not in kinds]
    return attach(keyed, cut(done.select(*changed), "analysed"), ["_text"], "_n", hot_rows=hot_rows).drop("_text", "_n")


def target_features(targets: DataFrame, v: Vocabulary = SPANISH, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Catalogue rows (product_code, name, weight_kg, context) with everything the rules and the estimate need."""
    rows = _per_text(targets, [F.col("name"), F.col("context")], lambda texts: reduce(DataFrame.withColumns, _target_columns(v), texts), hot_rows)
    return rows.withColumn("t_qty", Q.target_quantity(F.col("t_basis"), F.col("t_count"), F.col("t_size"), F.col("weight_kg")))


@lru_cache(maxsize=4)
def _listing_columns(v: Vocabulary) -> list[dict[str, Column]]:
    title, attrs, size = F.col("title"), F.col("attrs"), F.col("l_size")

    def place(t: Column) -> Column:
        return F.get(F.filter("l_stated", lambda e: e["t"] == t), F.lit(0))["p"]

    more = F.filter(F.transform("l_implied", lambda e: F.struct(e["t"].alias("t"), F.coalesce(place(e["by"]), F.lit(0)).alias("p"))),
                    lambda e: ~F.exists("l_stated", lambda s: s["t"] == e["t"]))
    return [
        {"title": F.trim(X.strip_control(X.repair_mojibake(F.coalesce("title", F.lit("")))))},
        {"l_words": X.title_words(title), "l_ordered": X.semantic_tokens(title, v), "l_stated": X.token_positions(title, v),
         "l_size": Q.parse_quantity(title), "l_dims": Q.dimensions(title), "l_kind": Q.quantity_kind(title)},
        {"l_mass": Q.candidate_quantity(title, attrs, size=size), "l_count": Q.candidate_quantity(title, attrs, "count", size),
         "l_canon": F.transform("l_words", lambda w: canonical_word(w, v=v)),
         "l_own": F.array_union(F.transform("l_stated", lambda e: e["t"]), F.col("l_ordered"))},
        {"l_implied": X.implied_words(F.col("l_own"), v)},
        {"l_pos": F.concat("l_stated", more), "l_tokens": F.array_union("l_own", F.transform("l_implied", lambda e: e["t"])),
         "l_flavor": X.has_flavor(F.col("l_own"), F.col("l_words"), v), "l_word_marks": class_marks(F.col("l_words"), v)},
        {"l_marks": class_marks(F.col("l_tokens"), v), "l_word_mask": _mask(F.col("l_word_marks"))},
        {"l_mask": _mask(F.col("l_marks"))},
    ]


def listing_features(listings: DataFrame, v: Vocabulary = SPANISH, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Retail rows (store, sku, title, attrs) with their words, word positions, implied words and quantities."""
    def analyse(texts: DataFrame) -> DataFrame:
        found = reduce(DataFrame.withColumns, _listing_columns(v), texts).drop("l_stated", "l_implied")
        return found.withColumnRenamed("title", "_title")

    found = _per_text(listings, [F.col("title"), F.col("attrs")], analyse, hot_rows)
    return found.withColumn("title", F.col("_title")).drop("_title")


def pair_features(pairs: DataFrame, v: Vocabulary = SPANISH, in_order: bool = False) -> DataFrame:
    """What several rules read of a pair: the listing's words for this target, their classes, and the place of the first target word.

    With `in_order` the pair is meant for `identity_reason` alone: `p_early` is what the first two rules say, and the place of the first word,
    which costs the most, is looked up for pairs that pass them only.
    """
    extra = one_of(F.col("t_head"), v.flavored_families) & F.col("l_flavor")
    own = _mask_of("saborizado", v)
    marked = F.array(F.struct(F.lit("saborizado").alias("t"), F.lit(own).cast("long").alias("m")))
    marks = F.when(extra, F.concat("l_marks", marked)).otherwise(F.col("l_marks")) if own else F.col("l_marks")
    mask = F.when(extra, F.col("l_mask").bitwiseOR(F.lit(own).cast("long"))).otherwise(F.col("l_mask"))
    pairs = pairs.withColumns({"p_cand": F.when(extra, F.array_union("l_tokens", F.array(F.lit("saborizado")))).otherwise(F.col("l_tokens")),
                               "p_marks": marks, "p_mask": mask})
    first = _first_target_word(v)
    if not in_order:
        return pairs.withColumn("p_first", first)
    pairs = pairs.withColumn("p_early", F.coalesce(rule_missing(), rule_containment(v)))
    return pairs.withColumn("p_first", F.when(F.col("p_early").isNull(), first))


PAIR = ("p_cand", "p_marks", "p_mask", "p_first", "p_early")


def position(token: Column, v: Vocabulary = SPANISH) -> Column:
    """Word index at which the listing shows a token, directly or through a word that implies it."""
    def of(t: Column) -> Column:
        return F.get(F.filter("l_pos", lambda e: e["t"] == t), F.lit(0))["p"]
    flavored = one_of(F.col("t_head"), v.flavored_families) & F.col("l_flavor") & (token == "saborizado")
    return F.coalesce(of(token), F.when(flavored, F.coalesce(of(F.col("t_head")), F.lit(0))))


def _reject(code: str, test: Column, text: Column | str) -> Column:
    text = F.lit(text) if isinstance(text, str) else text
    return F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(code).alias("code"), text.alias("text")))


def _found(code: str, found: Column, text: str, *first: Column) -> Column:
    """Reject when `found` (words) is not empty; the sorted words end the reason. `first` are cheaper tests that must hold too."""
    test = reduce(Column.__and__, [*first, F.size(found) > 0])
    return _reject(code, test, F.concat(F.lit(text), F.array_join(F.array_sort(found), ", ")))


def _quoted(items: Column) -> Column:
    return F.concat(F.lit("['"), F.array_join(F.array_sort(items), "', '"), F.lit("']"))




def rule_missing() -> Column:
    return _reject("R01", (F.size("t_req") == 0) | (F.size("l_ordered") == 0), "missing usable identity tokens")


def rule_containment(v: Vocabulary = SPANISH) -> Column:
    """Every required word must show; a family name may be replaced by one of its members."""
    missing = F.array_except("t_eff", "p_cand")
    by_member = F.arrays_overlap("p_cand", "t_members")
    missing = F.when(by_member, F.array_except(missing, F.array("t_head"))).otherwise(missing)
    return _found("R02", missing, "missing required identity word(s): ")


def rule_forbidden(v: Vocabulary = SPANISH) -> list[Column]:
    """Words that make a listing another kind of product, unless the target has them too."""
    allowed = F.col("t_all")

    def bad(name: str) -> Column:
        return F.array_except(_of_class("p_marks", name, v), allowed)

    def ban(code: str, name: str, text: str, *also: Column) -> Column:
        return _found(code, bad(name), text, _has("p_mask", name, v), *also)

    def listed(items: str) -> Column:
        return F.array_except(F.array_intersect("p_cand", items), allowed)

    drinks = F.when(_has("l_word_mask", "alcohol_free", v), F.array_except(bad("alcohol"), words(ALCOHOL_EXCUSED))).otherwise(bad("alcohol"))
    processed = F.array_except(F.array_union(_of_class("p_marks", "processed", v), _of_class("l_word_marks", "processed", v)), allowed)
    some = lambda items: F.size(items) > 0
    return [
        ban("R03", "non_food", "non-food product for a food target: ", F.col("t_food")),
        ban("R04", "pets", "pet product: "),
        _found("R05", drinks, "alcoholic product: ", _has("p_mask", "alcohol", v), ~F.array_contains(allowed, "vinagre")),
        ban("R06", "derived", "preparation/mix, not the product itself: ", ~F.col("t_variety")),
        ban("R07", "speciality", "speciality/premium version of the product: "),
        ban("R08", "prepared", "breaded/prepared version of the product: "),
        ban("R09", "deli", "cooked/deli/seasoned version of a raw meat product: ", one_of(F.col("t_line"), RAW_MEAT_LINES)),
        _found("R14", processed, "processed/canned product for a fresh-produce target: ", _has("p_mask", "processed", v) | _has("l_word_mask", "processed", v),
               one_of(F.col("t_family"), FRESH_FAMILIES)),
        _found("R15", _of_class("l_word_marks", "fresh_signs", v), "fresh product for a canned target: ", _has("l_word_mask", "fresh_signs", v), F.col("t_canned"),
               ~_has("l_word_mask", "canned", v)),
        _found("R18", F.array_intersect("p_cand", "t_forbidden"), "false-positive family term(s): ", some("t_forbidden")),
        _reject("R19", some("t_subtypes") & some(listed("t_subtypes")), F.concat(F.lit("unexpected subtype for plain '"), "t_head", F.lit("': "),
                F.array_join(F.array_sort(listed("t_subtypes")), ", "))),
        _found("R20", listed("t_generic"), "generic-family false positive term(s): ", some("t_generic")),
        _found("R21", F.array_except(_of_class("p_marks", "flavors", v), "t_flavors"), "different/extra flavour(s): ", some("t_flavors") & _has("p_mask", "flavors", v) & ~F.col("t_variety")),
    ]


def rule_exclusive_group(v: Vocabulary = SPANISH) -> list[Column]:
    """Both sides name members of a group of contradicting words, but no common one."""
    out = []
    groups = [("R16", f"group{i}", "conflicting subtype") for i in range(len(v.modifier_groups))] + [("R17", "form", "conflicting product form")]
    for code, name, text in groups:
        t, c = F.array_distinct(_of_class("t_marks", name, v)), F.array_distinct(_of_class("p_marks", name, v))
        clash = _has("t_mask", name, v) & _has("p_mask", name, v) & ~F.arrays_overlap(t, c)
        out.append(_reject(code, clash, F.concat(F.lit(text + ": target="), _quoted(t), F.lit(", candidate="), _quoted(c))))
    return out


def _first_target_word(v: Vocabulary) -> Column:
    """Earliest word index of any required word; the head may be shown by a family member."""
    spots = F.transform("t_eff", lambda t: F.coalesce(position(t, v), F.when(
        t == F.col("t_head"), F.array_min(F.transform("t_members", lambda m: position(m, v))))))
    return F.array_min(spots)


def rule_position(v: Vocabulary = SPANISH) -> list[Column]:
    """What the title is about must be the target: word order rules."""
    lead_word = F.get("l_ordered", F.lit(0))
    purpose = (F.size("t_purpose") > 0) & F.array_contains("t_purpose", lead_word) & ~F.array_contains("t_purpose", F.col("t_head"))
    lead = lambda p, start: F.when(p > start, F.slice("l_words", F.lit(start + 1), F.greatest(p - start, F.lit(0)))).otherwise(_none())
    marker = let(F.col("p_first"), lambda p: F.get(F.filter(lead(p, 1), lambda w: one_of(w, v.markers)), F.lit(0)))
    allowed = F.array_union(F.array_union("t_eff", "t_all"), F.col("t_members"))
    noun = let(F.col("p_first"), lambda p: F.get(F.filter(
        F.when(p > 0, F.slice("l_canon", F.lit(1), F.greatest(p, F.lit(0)))).otherwise(_none()),
        lambda w: one_of(w, v.nouns) & ~F.array_contains(allowed, w)), F.lit(0)))
    only = F.get("t_eff", F.lit(0))

    def made_from(p: Column) -> Column:
        before = F.slice("l_canon", F.lit(1), F.greatest(p - 1, F.lit(0)))
        known = F.exists(before, lambda w: F.exists("l_pos", lambda e: e["t"] == w))
        return (p >= 2) & F.get("l_words", p - 1).isin("de", "del") & known

    single = (F.size("t_eff") == 1) & (F.size("t_members") == 0)
    generic = (F.size("t_req") == 1) & one_of(F.col("t_head"), v.generic_query) & (F.size("t_members") == 0)
    at = F.array_position("l_ordered", F.col("t_head")) - 1
    return [
        _reject("R10", purpose, F.concat(F.lit("title is a '"), lead_word, F.lit("' product, the target is only for/with it"))),
        let(marker, lambda m: _reject("R11", m.isNotNull(), F.concat(F.lit("target word only appears after '"), m, F.lit("' (ingredient/flavour, not the product)")))),
        let(noun, lambda w: _reject("R12", w.isNotNull(), F.concat(F.lit("different product: title leads with '"), w, F.lit("'")))),
        _reject("R13", single & let(position(only, v), made_from), F.concat(F.lit("made from/with '"), only, F.lit("', not the product itself"))),
        _reject("R26", generic & (at < 0), F.concat(F.lit("missing core product word '"), "t_head", F.lit("'"))),
        _reject("R26", generic & (at > LATEST_HEAD_POSITION), F.concat(F.lit("generic product word '"), "t_head",
                F.lit("' appears too late in candidate title (position "), at.cast("string"), F.lit(")"))),
    ]


def rule_shape(v: Vocabulary = SPANISH) -> list[Column]:
    """Item size of counted goods, packaging dimensions, liquid against solid."""
    tq, cq = F.col("t_size.unit_kg"), F.col("l_size.unit_kg")
    ratio = F.when((tq > 0) & (cq > 0), cq / tq)
    pair = lambda d: F.concat(F.get(d, F.lit(0)).cast("string"), F.lit("x"), F.get(d, F.lit(1)).cast("string"))
    return [
        _reject("R22", (F.col("t_basis") == "count") & ~ratio.between(0.5, 2.0), F.concat(
            F.lit("different item size: target "), fixed(tq, 3), F.lit(", candidate "), fixed(cq, 3), F.lit(" (kg/L)"))),
        _reject("R23", F.col("t_dims").isNotNull() & F.col("l_dims").isNotNull() & (F.col("t_dims") != F.col("l_dims")), F.concat(
            F.lit("different dimensions: target "), pair("t_dims"), F.lit(", candidate "), pair("l_dims"))),
        _reject("R24", one_of(F.col("t_head"), v.liquids) & (F.col("t_kind") == "volume") & (F.col("l_kind") == "mass") & ~F.array_contains("t_all", "polvo"),
                "physical-form mismatch: liquid target vs mass-labelled candidate"),
        _reject("R25", one_of(F.col("t_head"), v.solids) & (F.col("t_kind") == "mass") & (F.col("l_kind") == "volume"),
                "physical-form mismatch: dry/mass target vs volume-labelled candidate"),
    ]


@lru_cache(maxsize=4)
def _rules_by_place(v: Vocabulary) -> tuple[list[Column], list[Column], list[Column]]:
    """The rules in order: those that read words alone, those that read sizes, those on words again."""
    ban, order = rule_forbidden(v), rule_position(v)
    return [F.col("p_early"), *ban[:7], *order[:4], *ban[7:9], *rule_exclusive_group(v), *ban[9:]], rule_shape(v), order[4:]


@lru_cache(maxsize=4)
def identity_reason(v: Vocabulary = SPANISH) -> Column:
    """struct(code, text) of the first rule that rejects the pair (with `pair_features` in order), NULL when none does."""
    words_first, shape, words_last = _rules_by_place(v)
    return F.coalesce(*words_first, *shape, *words_last)


# What the rules on words read of a target. Products that agree in it (their names differ in sizes only) get the same word verdict.
WORDS_OF_TARGET = ("t_req", "t_eff", "t_all", "t_head", "t_food", "t_members", "t_forbidden", "t_generic", "t_purpose", "t_subtypes", "t_canned",
                   "t_marks", "t_mask", "t_flavors", "t_variety", "t_line", "t_family")


def needed_words(v: Vocabulary = SPANISH) -> Column:
    """Words of a target without which `rule_missing` or `rule_containment` rejects a listing, whatever else the listing has."""
    need = F.when(one_of(F.col("t_head"), v.flavored_families), F.array_except("t_eff", words(["saborizado"]))).otherwise(F.col("t_eff"))
    need = F.when(F.size("t_members") > 0, F.array_except(need, F.array("t_head"))).otherwise(need)
    return F.coalesce(F.array_distinct(need), _none())


def refused_without_needed(pairs: DataFrame, v: Vocabulary = SPANISH) -> DataFrame:
    """`word_verdicts` of pairs that lack a needed word: the first two rules reject them, and no other rule is asked."""
    return pair_features(pairs, v, in_order=True).withColumn("w_first", F.col("p_early")).drop(*PAIR)


def word_verdicts(pairs: DataFrame, v: Vocabulary = SPANISH) -> DataFrame:
    """Adds what the rules on words say of a pair: `w_first` before, `w_last` after the rules on sizes; both NULL when none rejects."""
    words_first, _, words_last = _rules_by_place(v)
    judged = pair_features(pairs, v, in_order=True).withColumn("w_first", F.coalesce(*words_first))
    return judged.withColumn("w_last", F.when(F.col("w_first").isNull(), F.coalesce(*words_last))).drop(*PAIR)


def apply_rules(pairs: DataFrame, settings: PriceSettings = PriceSettings(), v: Vocabulary = SPANISH) -> DataFrame:
    """Candidate pairs with reason_code, reason, accepted, kg, size_ratio, price and price_per_kg.

    Input: `target_features` joined to `listing_features`, with regular_price, final_price, price and price_basis.
    """
    return _apply(pair_features(pairs, v, in_order=True), identity_reason(v), settings, v).drop(*PAIR)


def apply_to_worded(pairs: DataFrame, settings: PriceSettings = PriceSettings(), v: Vocabulary = SPANISH) -> DataFrame:
    """`apply_rules` for pairs that carry `word_verdicts`: only the rules on sizes are left, and the words are not read again."""
    return _apply(pairs, F.coalesce("w_first", *rule_shape(v), "w_last"), settings, v).drop("w_first", "w_last")


def refused_by_words(pairs: DataFrame, settings: PriceSettings = PriceSettings(), v: Vocabulary = SPANISH) -> DataFrame:
    """`apply_to_worded` for pairs with a `w_first`: no rule on sizes is asked, and `accepted` is a constant, so that a plan which reads accepted
    rows only drops them before any work."""
    return _apply(pairs, F.col("w_first"), settings, v).withColumn("accepted", F.lit(False)).drop("w_first", "w_last")


def _apply(pairs: DataFrame, verdict: Column, settings: PriceSettings, v: Vocabulary) -> DataFrame:
    counted = F.col("t_basis") == "count"
    qty = F.when(counted, F.col("l_count")).otherwise(F.col("l_mass"))
    one = pairs.withColumns({"_why": verdict, "_qty": qty,
                             "_price": choose_price(F.col("regular_price"), F.col("final_price"), F.col("price"), F.col("price_basis"), settings)})
    kg, price = F.col("_qty.kg"), F.col("_price.price")
    unreadable = ~F.coalesce(kg > 0, F.lit(False))
    why = F.coalesce(
        F.col("_why"),
        _reject("R27", unreadable & counted, "cannot count units in candidate title (target is priced per unit)"),
        _reject("R27", unreadable, "cannot normalize candidate to kg from title or safe attributes"),
        _reject("R28", price.isNull(), "missing usable retailer price"))
    identified = F.col("_identified")
    by_weight = F.col("l_mass.source").startswith("sold by weight")
    unit = F.when(counted, F.col("l_count.kg")).when(by_weight, F.col("l_mass.kg")).otherwise(F.coalesce("l_size.unit_kg", "l_mass.kg"))
    wanted = F.when(counted, F.col("t_count.n")).otherwise(F.coalesce("t_size.unit_kg", F.when(F.col("weight_kg") > 0, F.col("weight_kg"))))
    two = one.withColumns({"_why": why, "_identified": F.col("_why").isNull() & ~unreadable})
    return two.withColumns({
        "kg": kg, "quantity_source": F.col("_qty.source"), "target_unit_kg": F.when(identified, wanted),
        "candidate_unit_kg": F.when(identified, F.coalesce(unit, kg)), "size_ratio": F.when(identified, Q.size_ratio(wanted, unit)),
        "size_neutral": F.col("_qty.source").startswith("sold by weight") & one_of(F.col("t_family"), WEIGHED_NEUTRAL_FAMILIES),
        "chosen_basis": F.col("_price.basis"), "price": price, "price_per_kg": unit_price(price, kg, identified),
        "accepted": F.col("_why").isNull(), "reason_code": F.coalesce(F.col("_why.code"), F.lit("OK")),
        "reason": F.coalesce(F.col("_why.text"), F.lit("accepted by identity/subtype rules"))}).drop("_why", "_qty", "_price", "_identified")

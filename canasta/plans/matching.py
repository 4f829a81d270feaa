"""Candidate generation and identity rules over part-based catalogue and retail names."""

from __future__ import annotations

from pyspark.sql import functions as F

from canasta.operators import candidates, identity
from canasta.operators.skew import cut, spread
from canasta.plans.numeric import BALANCED, BAND, CLUSTER, MEMBERS, SPREAD, STATS, greedy, near, outliers
from canasta.plans.registry import query
from canasta.plans.texts import FEATURES, LISTING, RETAIL, SEARCH, TARGET, TITLE_LIST, at, canon, lst, minus, norm, ordered, raw_tokens, unparen, within
from canasta.sources import fixtures
from canasta.vocabulary import ALCOHOL_EXCUSED, ALCOHOL_FREE, BAKERY_FAMILIES, FRESH_FAMILIES, RAW_MEAT_LINES
from canasta.vocabulary import SPANISH as V


def pairs(spark, folder):
    """Every catalogue product against the retail titles of its group of parts."""
    t = cut(identity.target_features(fixtures.catalog(spark, folder)), "targets")
    return t.join(cut(identity.listing_features(fixtures.retail(spark, folder)), "listings"), "grp")


def by_head(table: dict) -> str:
    return "CASE head " + " ".join(f"WHEN '{k}' THEN {lst(x)}" for k, x in table.items()) + " ELSE []::VARCHAR[] END"


def after(marks, start: int = 1) -> str:
    return f"list_filter(list_transform(tcw, lambda c, i: CASE WHEN i > {start} AND tw[i - 1] IN {within(marks)} THEN c END), lambda c: c IS NOT NULL)"


ALLOW = ", ".join(f"CASE WHEN list_contains(tokens, '{k}') OR list_contains(mods, '{k}') THEN {lst(x)} ELSE []::VARCHAR[] END" for k, x in V.target_allows.items())
UNIT_T = "CASE sz WHEN 0 THEN p_size / 1000.0 WHEN 1 THEN p_size / 1000.0 END"
PAIRS = f"""{FEATURES}, {LISTING},
 th0 AS (SELECT *, req[1] AS head, list_distinct(list_concat(tokens, mods, {ALLOW})) AS allw, string_split({norm(unparen('name'))}, ' ') AS tw,
   list_has_any(string_split({norm(unparen('name'))}, ' '), {lst(V.variety)}) AS variety, {norm('line')} AS nline, {norm('category')} AS ncat FROM tf),
 th1 AS (SELECT *, {canon('tw')} AS tcw FROM th0),
 th AS (SELECT *, {by_head(V.members)} AS members, {by_head(V.family_forbidden)} AS ffor, {by_head(V.generic_forbidden)} AS gfor,
   CASE WHEN variety THEN {minus(by_head(V.family_subtypes), "['saborizado', 'saborizada']")} ELSE {by_head(V.family_subtypes)} END AS subs,
   CASE WHEN ncat <> '' THEN ncat <> 'no alimento' ELSE NOT list_has_any(allw, {lst(V.non_food)}) END AS food,
   list_intersect(list_concat({after(['para', 'con'])}, CASE WHEN nfamily IN {within(BAKERY_FAMILIES)} THEN {after(['de'], 2)} ELSE []::VARCHAR[] END), eff) AS purpose,
   list_has_any(tw, {lst(V.canned)}) AS canned, name LIKE 'Vasos%' OR name LIKE 'Fiambreras%' AS counted,
   CASE WHEN name LIKE 'Vasos%' THEN 9 * 0.028349523125 ELSE {UNIT_T} END AS tunit,
   CASE WHEN sz = 1 THEN 'volume' WHEN sz = 0 THEN 'mass' END AS tkind FROM th1),
 lh AS (SELECT *, sz AS lsz, p_size AS lsize, CASE WHEN title LIKE 'Vasos%' THEN 16 * 0.028349523125 WHEN sz IN (0, 1) THEN p_size / 1000.0 END AS lunit,
   CASE WHEN sz = 1 THEN 'volume' WHEN sz = 0 THEN 'mass' END AS lkind FROM lf),
 pr0 AS (SELECT th.*, lh.* EXCLUDE (grp, sz, p_size, r), CASE WHEN head IN {within(V.flavored_families)} AND flavored THEN list_concat(toks, ['saborizado']) ELSE toks END AS cand
  FROM th JOIN lh USING (grp)),
 pr AS (SELECT *, list_transform(list_concat(eff, members), lambda t: {{'t': t, 'p': CASE WHEN coalesce(list_position(pt, t), 0) > 0 THEN list_position(pt, t) - 1
    WHEN coalesce(list_position(it, t), 0) > 0 THEN greatest(coalesce(list_position(pt, ib[list_position(it, t)]), 0) - 1, 0)
    WHEN t = 'saborizado' AND head IN {within(V.flavored_families)} AND flavored THEN greatest(coalesce(list_position(pt, head), 0) - 1, 0) END}}) AS ps FROM pr0),
 pq AS (SELECT *, list_min(list_transform(list_filter(ps, lambda z: z.p IS NOT NULL AND (list_contains(eff, z.t) OR (list_contains(eff, head) AND list_contains(members, z.t)
    AND NOT coalesce(list_contains(cand, head), false)))), lambda z: z.p)) AS fp, list_filter(ps, lambda z: z.t = eff[1])[1].p AS p1 FROM pr)"""


def inter(a: str, b: str) -> str:
    return f"list_filter({a}, lambda y: list_contains({b}, y))"


def bad(items: str) -> str:
    return f"list_sort(list_distinct({minus(inter('cand', items), 'allw')}))"


def bad_words(items) -> str:
    return bad(lst(items))


def joined(e: str) -> str:
    return f"array_to_string({e}, ', ')"


def when(code: str, test: str, text: str) -> str:
    return f"WHEN {test} THEN '{code}|' || {text}"


def found(code: str, e: str, text: str, also: str = "true") -> str:
    return when(code, f"len({e}) > 0 AND {also}", f"'{text}' || {joined(e)}")


MISSING = f"list_sort(CASE WHEN list_has_any(cand, members) THEN {minus(minus('eff', 'cand'), '[head]')} ELSE {minus('eff', 'cand')} END)"
DRINKS = bad_words(V.alcohol)
DRINKS = f"(CASE WHEN list_has_any(w, {lst(ALCOHOL_FREE)}) THEN {minus(DRINKS, lst(ALCOHOL_EXCUSED))} ELSE {DRINKS} END)"
PROC = f"list_sort(list_distinct({minus(inter('list_concat(cand, w)', lst(V.processed)), 'allw')}))"
FRESHLY = f"list_sort(list_distinct({inter('w', lst(V.fresh_signs))}))"
OWN = inter("allw", lst(V.flavors))
R01 = when("R01", "len(req) = 0 OR len(ord) = 0", "'missing usable identity tokens'")
R02 = found("R02", MISSING, "missing required identity word(s): ")
BAN = [
    found("R03", bad_words(V.non_food), "non-food product for a food target: ", "food"), found("R04", bad_words(V.pets), "pet product: "),
    found("R05", DRINKS, "alcoholic product: ", "NOT list_contains(allw, 'vinagre')"),
    found("R06", bad_words(V.derived), "preparation/mix, not the product itself: ", "NOT variety"),
    found("R07", bad_words(V.speciality), "speciality/premium version of the product: "),
    found("R08", bad_words(V.prepared), "breaded/prepared version of the product: "),
    found("R09", bad_words(V.deli), "cooked/deli/seasoned version of a raw meat product: ", f"nline IN {within(RAW_MEAT_LINES)}"),
    found("R14", PROC, "processed/canned product for a fresh-produce target: ", f"nfamily IN {within(FRESH_FAMILIES)}"),
    found("R15", FRESHLY, "fresh product for a canned target: ", f"canned AND NOT list_has_any(w, {lst(V.canned)})"),
    found("R18", f"list_sort(list_distinct({inter('cand', 'ffor')}))", "false-positive family term(s): "),
    when("R19", f"len({bad('subs')}) > 0", f"'unexpected subtype for plain ''' || head || ''': ' || {joined(bad('subs'))}"),
    found("R20", bad("gfor"), "generic-family false positive term(s): "),
    found("R21", f"list_sort(list_distinct({minus(inter('cand', lst(V.flavors)), OWN)}))", "different/extra flavour(s): ", f"len({OWN}) > 0 AND NOT variety")]


def group_rule(code: str, group, text: str) -> str:
    g = lst(group)
    t, c = f"list_sort(list_distinct({inter('allw', g)}))", f"list_sort(list_distinct({inter('cand', g)}))"
    show = lambda e: f"'[''' || array_to_string({e}, ''', ''') || ''']'"
    return when(code, f"len({t}) > 0 AND len({c}) > 0 AND NOT list_has_any({t}, {c})", f"'{text}: target=' || {show(t)} || ', candidate=' || {show(c)}")


GROUPS = [group_rule("R16", g, "conflicting subtype") for g in V.modifier_groups] + [group_rule("R17", V.form, "conflicting product form")]
MARK = f"list_filter(w[2:fp], lambda y: y IN {within(V.markers)})[1]"
NOUN = f"list_filter(cw[1:fp], lambda y: y IN {within(V.nouns)} AND NOT list_contains(list_concat(eff, allw, members), y))[1]"
PLACE = [
    when("R10", "len(purpose) > 0 AND list_contains(purpose, ord[1]) AND NOT list_contains(purpose, head)", "'title is a ''' || ord[1] || ''' product, the target is only for/with it'"),
    when("R11", f"fp > 1 AND {MARK} IS NOT NULL", f"'target word only appears after ''' || {MARK} || ''' (ingredient/flavour, not the product)'"),
    when("R12", f"fp > 0 AND {NOUN} IS NOT NULL", f"'different product: title leads with ''' || {NOUN} || ''''"),
    when("R13", "len(eff) = 1 AND len(members) = 0 AND p1 >= 2 AND w[p1] IN ('de', 'del') AND len(list_filter(cw[1:(p1 - 1)], lambda y: list_contains(pt, y) OR list_contains(it, y))) > 0",
         "'made from/with ''' || eff[1] || ''', not the product itself'"),
    when("R26", f"len(req) = 1 AND head IN {within(V.generic_query)} AND len(members) = 0 AND coalesce(list_position(ord, head), 0) = 0", "'missing core product word ''' || head || ''''"),
    when("R26", f"len(req) = 1 AND head IN {within(V.generic_query)} AND len(members) = 0 AND list_position(ord, head) > 4",
         "'generic product word ''' || head || ''' appears too late in candidate title (position ' || (list_position(ord, head) - 1) || ')'")]
SHAPE = [
    when("R22", "counted AND tunit > 0 AND lunit > 0 AND NOT (lunit / tunit BETWEEN 0.5 AND 2)",
         "'different item size: target ' || printf('%.3f', tunit::DOUBLE) || ', candidate ' || printf('%.3f', lunit::DOUBLE) || ' (kg/L)'"),
    when("R23", "name LIKE 'Fiambreras%' AND title LIKE '%8x8%'", "'different dimensions: target 7x7, candidate 8x8'"),
    when("R24", f"head IN {within(V.liquids)} AND tkind = 'volume' AND lkind = 'mass' AND NOT list_contains(allw, 'polvo')", "'physical-form mismatch: liquid target vs mass-labelled candidate'"),
    when("R25", f"head IN {within(V.solids)} AND tkind = 'mass' AND lkind = 'volume'", "'physical-form mismatch: dry/mass target vs volume-labelled candidate'")]


def first_of(rules) -> str:
    return "CASE " + " ".join(rules) + " END"


def rules_sql(rules) -> str:
    return f"WITH {PAIRS} SELECT product_code, sku, {first_of(rules)} AS verdict FROM pq"


def verdict(spark, folder, rules, in_order=False):
    why = F.coalesce(*rules)
    return identity.pair_features(pairs(spark, folder), in_order=in_order).withColumn("y", why).select("product_code", "sku", F.concat_ws("|", "y.code", "y.text").alias("v")).select(
        "product_code", "sku", F.when(F.col("v") != "", F.col("v")).alias("verdict"))


@query("rule_containment", rules_sql([R02]))
def rule_containment(spark, folder):
    return verdict(spark, folder, [identity.rule_containment()])


@query("rule_forbidden", rules_sql(BAN))
def rule_forbidden(spark, folder):
    return verdict(spark, folder, identity.rule_forbidden())


@query("rule_exclusive_group", rules_sql(GROUPS))
def rule_exclusive_group(spark, folder):
    return verdict(spark, folder, identity.rule_exclusive_group())


@query("rule_position", rules_sql(PLACE))
def rule_position(spark, folder):
    return verdict(spark, folder, identity.rule_position())


@query("rule_shape", rules_sql(SHAPE))
def rule_shape(spark, folder):
    return verdict(spark, folder, identity.rule_shape())


ALL_RULES = [R01, R02, *BAN[:7], *PLACE[:4], *BAN[7:9], *GROUPS, *BAN[9:], *SHAPE, *PLACE[4:]]


@query("first_reason", rules_sql(ALL_RULES))
def first_reason(spark, folder):
    return verdict(spark, folder, [identity.identity_reason()], in_order=True)


def rules_applied(spark, folder):
    return identity.apply_rules(pairs(spark, folder))


QTY = """CASE WHEN counted THEN CASE WHEN lsz = 2 THEN lsize WHEN title LIKE '100%' THEN 100 WHEN lunit IS NOT NULL THEN 1 END
  WHEN att = 0 THEN 1 WHEN lunit IS NOT NULL THEN lunit WHEN att = 1 THEN lsize / 1000.0 END"""
APPLIED = f"""{PAIRS}, ap0 AS (SELECT *, {first_of(ALL_RULES)} AS why, {QTY} AS kg, coalesce(regular_price, final_price) AS chosen FROM pq),
 ap AS (SELECT *, CASE WHEN why IS NOT NULL THEN why WHEN coalesce(kg, 0) <= 0 THEN 'R27|' || CASE WHEN counted THEN 'cannot count units in candidate title (target is priced per unit)'
   ELSE 'cannot normalize candidate to kg from title or safe attributes' END WHEN chosen IS NULL THEN 'R28|missing usable retailer price' END AS verdict,
  why IS NULL AND coalesce(kg, 0) > 0 AS identified,
  CASE WHEN counted THEN CASE WHEN name LIKE 'Vasos%' THEN 150 ELSE 200 END WHEN tunit IS NOT NULL THEN tunit ELSE weight_kg END AS wanted,
  CASE WHEN counted THEN kg WHEN att = 0 THEN 1 WHEN lunit IS NOT NULL THEN lunit WHEN att = 1 THEN lsize / 1000.0 END AS unit FROM ap0)"""


@query("apply_rules", f"""WITH {APPLIED} SELECT product_code, sku, coalesce(split_part(verdict, '|', 1), 'OK') AS reason_code, verdict IS NULL AS accepted,
 CASE WHEN identified THEN round(unit / wanted + 3.7e-6, 4)::DOUBLE END AS size_ratio, CASE WHEN identified THEN round(chosen / kg + 3.7e-6, 4)::DOUBLE END AS price_per_kg FROM ap""")
def apply_rules(spark, folder):
    rows = rules_applied(spark, folder)
    return rows.select("product_code", "sku", "reason_code", "accepted", near("size_ratio").alias("size_ratio"), near("price_per_kg").alias("price_per_kg"))


def series(spark, folder):
    """Names with a series word shared by twelve parts, so a target reaches as many listings at every scale."""
    word = F.concat(F.lit("serie"), F.floor(F.col("p_partkey") / 12))
    ctx = F.struct(*[F.lit("").alias(c) for c in ("line", "family", "description", "grp", "category")])
    part = spread(fixtures.read(spark, folder, "part"))
    targets = part.select(F.col("p_partkey").alias("product_code"), F.concat_ws(" ", word, "p_name").alias("name"), F.lit(None).cast("double").alias("weight_kg"), ctx.alias("context"))
    titles = part.select((F.col("p_partkey") % 4).alias("store"), F.col("p_partkey").cast("string").alias("sku"),
                         F.concat_ws(" ", "p_name", "p_type", word, F.concat("p_size", F.lit("kg"))).alias("title"), F.create_map().cast("map<string,string>").alias("attrs"))
    return identity.target_features(targets), identity.listing_features(titles)


@query("candidate_join", """WITH p AS (SELECT p_partkey, p_partkey // 12 AS g, string_split(p_name, ' ') AS n, list_concat(string_split(p_name, ' '), [lower(p_type)]) AS t FROM part),
 m AS (SELECT a.p_partkey AS product_code, b.p_partkey % 4 AS store, b.p_partkey::VARCHAR AS sku, CASE WHEN list_contains(b.t, a.n[1]) AND list_contains(b.t, a.n[2]) THEN 0
   WHEN list_contains(b.t, a.n[2]) THEN 1 WHEN list_contains(b.t, a.n[1]) THEN 2 END AS query_rank FROM p a JOIN p b USING (g))
 SELECT product_code, store, sku, query_rank FROM m WHERE query_rank IS NOT NULL""")
def candidate_join(spark, folder):
    targets, titles = series(spark, folder)
    return candidates.candidate_join(targets, titles).select("product_code", "store", "sku", "query_rank")


# -- the whole run: the series fixture's names and titles, joined by brute force, cleaned and priced ------------------

SERIES_TARGET = f"""tg AS (SELECT p_partkey AS product_code, p_partkey // 60 AS grp, {at(lst([t[0] for t in fixtures.TARGETS[:6]]), 'p_partkey // 60')} || ' serie' || (p_partkey // 60) || ' ' || (p_size * 20) || 'g' AS name,
 CASE WHEN p_partkey % 4 <> 0 THEN p_size / 40.0 END AS weight_kg, '' AS line, '' AS family, 'Alimento' AS category, p_size * 20 AS p_size, 0 AS sz FROM part)"""
SERIES_TITLE = f"""CASE WHEN p_partkey % 5 = 0 THEN {at(TITLE_LIST, 'p_partkey')} ELSE {at(lst([t[0] for t in fixtures.TARGETS[:6]]), 'p_partkey // 60')} || ' ' || {at(lst(['Estrella', 'Bonlac', 'Dos Pinos', 'Super']), 'p_partkey')} END"""
SERIES_RETAIL = f"""rt AS (SELECT p_partkey % 4 AS store, p_partkey::VARCHAR AS sku, p_partkey // 60 AS grp, {SERIES_TITLE} || ' serie' || (p_partkey // 60) || ' ' || (p_size * 20) || 'g' AS title,
 p_retailprice / 400 * (p_size + 10) / 30 AS regular_price, NULL::DOUBLE AS final_price, 2 AS att, 0 AS sz, p_size * 20 AS p_size FROM part)"""
SERIES_HITS = f"""qw0 AS (SELECT DISTINCT unnest({ordered('q')}) AS query FROM qs), qw1 AS (SELECT query, {raw_tokens('query')} AS qr FROM qw0), qw AS (SELECT query, {ordered('qr')} AS words FROM qw1),
 ht AS (SELECT query, store, sku FROM qw JOIN lh ON len(words) > 0 AND list_has_all(toks, words)),
 cj AS (SELECT product_code, store, sku, min(rk) AS query_rank FROM (SELECT product_code, unnest({ordered('q')}) AS query, generate_subscripts({ordered('q')}, 1) - 1 AS rk FROM qs) JOIN ht USING (query) GROUP BY 1, 2, 3),"""
SERIES = (SEARCH.replace(TARGET, SERIES_TARGET) + APPLIED[len(FEATURES):].replace(RETAIL, SERIES_RETAIL).replace(" pr0 AS (", f" {SERIES_HITS} pr0 AS (")
          .replace("FROM th JOIN lh USING (grp)", "FROM cj JOIN th ON cj.product_code = th.product_code JOIN lh ON cj.store = lh.store AND cj.sku = lh.sku"))
ALIKE = """((list_sort(k.toks) = list_sort(r.own_words) AND round(k.kg, 3) = round(r.kg, 3))
 OR len(list_intersect(k.toks, r.own_words)) / len(list_distinct(list_concat(k.toks, r.own_words))) >= 0.8::DOUBLE)"""
NAMED_GREEDY = (greedy("sz", "size_kept").replace("u DOUBLE)[]", "u DOUBLE, toks VARCHAR[])[]").replace("'u': u}", "'u': u, 'toks': own_words}")
                .replace("r.price_per_kg AS u,", "r.price_per_kg AS u, r.own_words,").replace("<= 0.15::DOUBLE))[1]", f"<= 0.15::DOUBLE AND {ALIKE}))[1]"))
JUDGED = f"""SELECT product_code, store, sku, list_distinct(ord) AS own_words, kg, chosen AS price, verdict IS NULL AS accepted, false AS size_neutral,
  coalesce(split_part(verdict, '|', 1), 'OK') AS rule, CASE WHEN identified THEN chosen / kg END AS price_per_kg, CASE WHEN identified THEN unit / wanted END AS size_ratio FROM ap"""
# The search reads a store's pages query by query until five close or ten good matches are found; a store left with fewer than five good ones is read on.
FIRST_PAGES = 2
SEARCHED = f"""xa AS (SELECT j.*, query_rank, (j.sku::BIGINT // 4) % 5 + 1 AS page FROM ({JUDGED}) j JOIN cj USING (product_code, store, sku)),
 pg AS (SELECT product_code, store, query_rank, page, count(*) FILTER (accepted AND size_ratio BETWEEN 0.67::DOUBLE AND 1.5::DOUBLE) AS c, count(*) FILTER (accepted) AS g FROM xa GROUP BY ALL),
 s1 AS (SELECT * FROM (SELECT *, coalesce(sum(c) OVER w, 0) AS cb, coalesce(sum(g) OVER w, 0) AS gb FROM pg WHERE page <= {FIRST_PAGES}
  WINDOW w AS (PARTITION BY product_code, store ORDER BY query_rank, page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE cb < 5 AND gb < 10),
 k1 AS (SELECT product_code, store, sum(c) AS c1, sum(g) AS g1 FROM s1 GROUP BY 1, 2),
 s2 AS (SELECT * FROM (SELECT pg.*, coalesce(c1, 0) + coalesce(sum(c) OVER w, 0) AS cb, coalesce(g1, 0) + coalesce(sum(g) OVER w, 0) AS gb, row_number() OVER w2 AS rn FROM pg LEFT JOIN k1 USING (product_code, store)
  WHERE page > {FIRST_PAGES} AND coalesce(g1, 0) < 5 WINDOW w AS (PARTITION BY pg.product_code, pg.store ORDER BY query_rank, page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  w2 AS (PARTITION BY pg.product_code, pg.store ORDER BY query_rank, page)) WHERE rn = 1 OR (cb < 5 AND gb < 10)),
 x AS (SELECT xa.* FROM xa JOIN (SELECT product_code, store, query_rank, page FROM s1 UNION ALL SELECT product_code, store, query_rank, page FROM s2) USING (product_code, store, query_rank, page))"""


def run_sql(x: str) -> str:
    return f"""WITH RECURSIVE {SERIES}, {x},
 {BAND}, {CLUSTER}, {MEMBERS}, {NAMED_GREEDY}, u1 AS (SELECT *, size_kept AND duplicate_of IS NULL AS uq FROM d), {outliers('u1', 'uq')},
 c AS (SELECT *, CASE WHEN NOT accepted THEN 'REJECTED' WHEN NOT size_kept THEN 'SIZE' WHEN duplicate_of IS NOT NULL THEN 'DUPLICATE'
  WHEN off_band OR off_mad THEN 'OUTLIER' ELSE 'ACCEPTED' END AS status FROM o)"""


RUN = run_sql(f"x AS ({JUDGED})")


def priced_sql(run: str) -> str:
    return f"""{run}, {STATS}, {BALANCED}, {SPREAD}, ct AS (SELECT product_code, count(*) FILTER (status <> 'REJECTED') AS raw_accepted, count(*) FILTER (status = 'SIZE') AS size_removed,
  count(*) FILTER (status = 'DUPLICATE') AS duplicates, count(*) FILTER (status = 'OUTLIER') AS outliers, count(*) FILTER (status = 'ACCEPTED') AS n, count(*) FILTER (status <> 'ACCEPTED') AS rejected FROM c GROUP BY 1)
 SELECT tg.product_code, tg.name, coalesce(ct.raw_accepted, 0) AS raw_accepted, coalesce(ct.size_removed, 0) AS size_removed, coalesce(ct.duplicates, 0) AS duplicates, coalesce(ct.outliers, 0) AS outliers,
  coalesce(ct.n, 0) AS n, coalesce(ct.rejected, 0) AS rejected, coalesce(ba.store_count, 0) AS store_count, round(p_size / 1000.0 + 3.7e-6, 4)::DOUBLE AS target_kg, round(ba.average + 3.7e-6, 4) AS average,
  round(sp.median + 3.7e-6, 4) AS median, round(ba.economy + 3.7e-6, 4) AS economy, round(ba.economy * (p_size / 1000.0) * 0.2 + 3.7e-6, 4)::DOUBLE AS estimate, round(sp.min + 3.7e-6, 4) AS min, round(sp.max + 3.7e-6, 4) AS max,
  round(sp.cv + 3.7e-6, 4) AS cv FROM tg LEFT JOIN ct USING (product_code) LEFT JOIN ba USING (product_code) LEFT JOIN sp USING (product_code)""".replace("FROM x WHERE accepted", "FROM c WHERE status = 'ACCEPTED'")


def whole_run(spark, folder):
    from canasta.plans.price_run import price_run as run
    return run(*fixtures.series_catalog(spark, folder), stores=[0, 1, 2, 3])


@query("price_run", priced_sql(RUN))
def price_run(spark, folder):
    """Names and titles to one estimate per product, every step of the library in one run."""
    summary, _ = whole_run(spark, folder)
    exact = ["product_code", "name", "raw_accepted", "size_removed", "duplicates", "outliers", "n", "rejected", "store_count"]
    return summary.select(*exact, *[near(c).alias(c) for c in ("target_kg", "average", "median", "economy", "estimate", "min", "max", "cv")])


@query("price_run_audit", f"{RUN} SELECT product_code, store, sku, status, CASE WHEN status IN ('REJECTED', 'ACCEPTED') THEN rule ELSE status END AS reason_code, duplicate_of FROM c")
def price_run_audit(spark, folder):
    """Every candidate of the whole run with its end and the reason's code."""
    return whole_run(spark, folder)[1].select("product_code", "store", "sku", "status", "reason_code", "duplicate_of")


@query("price_run_search", priced_sql(run_sql(SEARCHED)))
def price_run_search(spark, folder):
    """The whole run over listings that stand on the pages of a store's answer: the search stops where the evidence suffices."""
    from canasta.plans.price_run import price_run as run
    targets, listings = fixtures.series_catalog(spark, folder)
    paged = listings.withColumn("page", (F.floor(F.col("sku").cast("bigint") / 4) % 5 + 1).cast("int"))
    summary, _ = run(targets, paged, stores=[0, 1, 2, 3], first_pages=FIRST_PAGES)
    exact = ["product_code", "name", "raw_accepted", "size_removed", "duplicates", "outliers", "n", "rejected", "store_count"]
    return summary.select(*exact, *[near(c).alias(c) for c in ("target_kg", "average", "median", "economy", "estimate", "min", "max", "cv")])

"""Size peers, duplicates, outliers, aggregates and estimates over the line-item listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from canasta.operators import candidates, cleaning, flags, pricing
from canasta.functions.money import choose_price, fixed, unit_price
from canasta.plans.registry import query
from canasta.settings import PriceSettings
from canasta.sources import fixtures, tables

X1 = """x AS (
 SELECT l_partkey AS product_code, l_suppkey % 4 AS store, concat_ws('-', l_orderkey, l_linenumber, l_suppkey) AS sku,
  l_quantity AS kg, l_extendedprice AS price, l_extendedprice AS regular_price, l_extendedprice * (1 - l_discount) AS final_price,
  l_discount AS discount, l_extendedprice / l_quantity AS price_per_kg, p_size AS target_kg, l_quantity / p_size AS size_ratio,
  l_shipdate AS ts, l_linenumber AS page, l_tax = 0 AS size_neutral, l_returnflag <> 'R' AS accepted
 FROM lineitem JOIN part ON l_partkey = p_partkey)"""

# X1 with a missing size on every seventh page, so the "no ratio" branches have rows.
X1_HOLES = X1.replace("l_quantity / p_size AS size_ratio", "CASE WHEN l_linenumber <> 7 THEN l_quantity / p_size END AS size_ratio")

BAND = """n AS (SELECT product_code,
  count(*) FILTER (accepted AND size_ratio > 0) AS sized,
  count(*) FILTER (accepted AND size_ratio BETWEEN 0.8::DOUBLE AND 1.25::DOUBLE) AS pref,
  count(*) FILTER (accepted AND size_ratio BETWEEN 0.67::DOUBLE AND 1.5::DOUBLE) AS near,
  count(*) FILTER (accepted AND size_ratio > 0 AND NOT size_neutral) AS packaged FROM x GROUP BY 1),
 b AS (SELECT x.*, packaged, CASE WHEN sized = 0 THEN 'NO SIZE DATA' WHEN pref >= 3 AND (pref >= 5 OR near <= pref) THEN 'PREFERRED'
  WHEN near >= 2 THEN 'CLOSE' ELSE 'FALLBACK' END AS strategy FROM x JOIN n USING (product_code)),
 a0 AS (SELECT *, strategy = 'FALLBACK' AND accepted AND coalesce(size_ratio > 0, false) AND size_neutral AND packaged > 0 AS set_aside FROM b)"""

CLUSTER = """f AS (SELECT *, strategy = 'FALLBACK' AND accepted AND coalesce(size_ratio > 0, false) AND NOT set_aside AS choosing FROM a0),
 ff AS (SELECT * FROM f WHERE choosing),
 t AS (SELECT product_code, count(DISTINCT store) AS all_stores FROM ff GROUP BY 1),
 an AS (SELECT q.product_code, q.size_ratio AS anchor, count(*) AS members, count(DISTINCT m.store) AS stores
  FROM (SELECT DISTINCT product_code, size_ratio FROM ff) q JOIN ff m ON q.product_code = m.product_code
   AND m.size_ratio / q.size_ratio BETWEEN 1 / 1.75::DOUBLE AND 1.75::DOUBLE GROUP BY 1, 2),
 ti AS (SELECT an.*, CASE WHEN members >= 5 AND stores >= least(2, all_stores) THEN 3 WHEN members >= 3 AND stores >= least(2, all_stores) THEN 2
   WHEN members >= 3 THEN 1 ELSE 0 END AS tier FROM an JOIN t USING (product_code)),
 best AS (SELECT product_code, anchor, tier FROM ti
  QUALIFY row_number() OVER (PARTITION BY product_code ORDER BY tier DESC, greatest(anchor, 1 / anchor), anchor) = 1)"""

MEMBERS = """me AS (SELECT ff.product_code, ff.store, ff.sku, ff.price, row_number() OVER (PARTITION BY ff.product_code, ff.store
   ORDER BY greatest(size_ratio, 1 / size_ratio), sku, price) AS closeness
  FROM ff JOIN best USING (product_code) WHERE size_ratio / anchor BETWEEN 1 / 1.75::DOUBLE AND 1.75::DOUBLE),
 sz AS (SELECT f.*, best.anchor, CASE WHEN NOT accepted THEN false WHEN strategy = 'NO SIZE DATA' OR set_aside THEN true
   WHEN NOT coalesce(size_ratio > 0, false) THEN false WHEN strategy = 'PREFERRED' THEN size_ratio BETWEEN 0.8::DOUBLE AND 1.25::DOUBLE
   WHEN strategy = 'CLOSE' THEN size_ratio BETWEEN 0.67::DOUBLE AND 1.5::DOUBLE ELSE coalesce(closeness <= 10, false) END AS size_kept
  FROM f LEFT JOIN best USING (product_code) LEFT JOIN me ON f.product_code = me.product_code AND f.store = me.store AND f.sku = me.sku AND f.price = me.price)"""


def greedy(source: str, flag: str) -> str:
    """Sequential greedy choice by a recursive query: the kept listings travel along each group in sku order."""
    return f"""r AS (SELECT *, row_number() OVER (PARTITION BY product_code, store ORDER BY sku, price_per_kg) AS rn FROM {source}
  WHERE {flag} AND kg > 0 AND price_per_kg > 0),
 g AS (SELECT DISTINCT product_code, store, 0::BIGINT AS rn, []::STRUCT(sku VARCHAR, kg DOUBLE, u DOUBLE)[] AS kept,
   NULL::VARCHAR AS sku, NULL::DOUBLE AS price, NULL::VARCHAR AS dup FROM r
  UNION ALL
  SELECT product_code, store, rn, CASE WHEN dup IS NULL THEN list_append(kept, {{'sku': sku, 'kg': kg, 'u': u}}) ELSE kept END, sku, price, dup
  FROM (SELECT g.product_code, g.store, r.rn, g.kept, r.sku, r.price, r.kg, r.price_per_kg AS u,
     (list_filter(g.kept, lambda k: k.sku = r.sku OR (abs(k.kg - r.kg) / greatest(k.kg, r.kg) <= 0.1::DOUBLE
       AND abs(k.u - r.price_per_kg) / greatest(k.u, r.price_per_kg) <= 0.15::DOUBLE))[1]).sku AS dup
    FROM g JOIN r ON r.product_code = g.product_code AND r.store = g.store AND r.rn = g.rn + 1)),
 d AS (SELECT s.*, g.dup AS duplicate_of FROM {source} s LEFT JOIN g ON g.rn > 0 AND s.product_code = g.product_code
   AND s.store = g.store AND s.sku = g.sku AND s.price = g.price)"""


def outliers(source: str, flag: str) -> str:
    return f"""m AS (SELECT product_code, count(*) AS np, quantile_cont(price_per_kg, 0.5) AS med, quantile_cont(ln(price_per_kg), 0.5) AS lmed
  FROM {source} WHERE {flag} AND price_per_kg > 0 GROUP BY 1),
 ma AS (SELECT product_code, quantile_cont(abs(ln(price_per_kg) - lmed), 0.5) AS mad FROM {source} JOIN m USING (product_code)
  WHERE {flag} AND price_per_kg > 0 AND np >= 5 GROUP BY 1),
 o0 AS (SELECT s.*, np, med, CASE WHEN {flag} AND price_per_kg > 0 AND np >= 5 THEN 0.6745 * abs(ln(price_per_kg) - lmed) / greatest(mad, 0.05) END AS z,
   coalesce({flag} AND price_per_kg > 0 AND np >= 3 AND (price_per_kg < med * 0.5 OR price_per_kg > med * 2), false) AS off_band
  FROM {source} s LEFT JOIN m USING (product_code) LEFT JOIN ma USING (product_code)),
 o AS (SELECT *, coalesce(z > 3.5 AND NOT off_band, false) AS off_mad FROM o0)"""


CLEAN = f"""WITH RECURSIVE {X1_HOLES}, {BAND}, {CLUSTER}, {MEMBERS}, {greedy('sz', 'size_kept')},
 u1 AS (SELECT *, size_kept AND duplicate_of IS NULL AS uq FROM d), {outliers('u1', 'uq')},
 c AS (SELECT *, CASE WHEN NOT accepted THEN 'REJECTED' WHEN NOT size_kept THEN 'SIZE' WHEN duplicate_of IS NOT NULL THEN 'DUPLICATE'
  WHEN off_band OR off_mad THEN 'OUTLIER' ELSE 'ACCEPTED' END AS status FROM o)"""

STATS = """st AS (SELECT product_code, store, avg(price_per_kg) AS average, quantile_cont(price_per_kg, 0.5) AS median,
  quantile_cont(price_per_kg, 0.25) AS economy, count(*) AS n FROM x WHERE accepted GROUP BY 1, 2)"""
BALANCED = """ba AS (SELECT product_code, sum(average * least(n, 3)) / sum(least(n, 3)) AS average, sum(economy * least(n, 3)) / sum(least(n, 3)) AS economy,
  sum(median * least(n, 3)) / sum(least(n, 3)) AS median, count(*) AS store_count, sum(n)::BIGINT AS n FROM st GROUP BY 1)"""
SPREAD = """sp AS (SELECT product_code, count(*) AS n, quantile_cont(price_per_kg, 0.5) AS median, min(price_per_kg) AS min, max(price_per_kg) AS max,
  max(price_per_kg) / min(price_per_kg) AS ratio, CASE WHEN count(*) > 1 THEN stddev_pop(price_per_kg) / avg(price_per_kg) ELSE 0 END AS cv,
  CASE WHEN count(*) < 5 THEN max(price_per_kg) / min(price_per_kg)
   ELSE quantile_cont(price_per_kg, 0.9) / quantile_cont(price_per_kg, 0.1) END AS spread FROM x WHERE accepted GROUP BY 1)"""
KEY = ["product_code", "store", "sku", "price"]
KEYS = "product_code, store, sku, price"


def x1(spark, folder):
    return fixtures.listings(spark, folder)


def x1_holes(spark, folder):
    return x1(spark, folder).withColumn("size_ratio", F.when(F.col("page") != 7, F.col("size_ratio")))


# What the cleaning reads of a listing; the queries carry no other column through its shuffles.
CLEANED = ["product_code", "store", "sku", "price", "kg", "price_per_kg", "size_ratio", "size_neutral", "accepted"]


def cleaned_x1(spark, folder, *columns):
    return cleaning.clean_listings(x1_holes(spark, folder).select(*CLEANED), columns=columns)


def clean_x1(spark, folder):
    return x1(spark, folder).where("accepted")


def near(c, d=4):
    """Rounded for comparison; the nudge keeps exact decimal ties from falling differently in the two engines."""
    return F.round(F.col(c) + 3.7 * 10 ** -(d + 2), d)


def r(c, d=4):
    return near(c, d).alias(c)


@query("size_band", f"WITH {X1}, {BAND} SELECT {KEYS}, strategy FROM b")
def size_band(spark, folder):
    return cleaning.size_band(x1(spark, folder)).select(*KEY, "strategy")


@query("size_neutral", f"WITH {X1}, {BAND} SELECT strategy, set_aside, count(*) AS n FROM a0 GROUP BY 1, 2")
def size_neutral(spark, folder):
    marked = cleaning.size_neutral(cleaning.size_band(x1(spark, folder)))
    return marked.groupBy("strategy", "set_aside").agg(F.count(F.lit(1)).alias("n"))


@query("retail_cluster", f"WITH {X1}, {BAND}, {CLUSTER} SELECT product_code, round(anchor + 3.7e-8, 6) AS anchor, tier::BIGINT AS tier FROM best")
def retail_cluster(spark, folder):
    anchors = cleaning.retail_cluster(cleaning.size_band(x1(spark, folder)))
    return anchors.select("product_code", r("anchor", 6), F.col("tier").cast("long").alias("tier"))


@query("closest_per_store", f"""WITH {X1} SELECT {KEYS}, row_number() OVER w AS closeness FROM x
 WINDOW w AS (PARTITION BY product_code, store ORDER BY greatest(size_ratio, 1 / size_ratio), sku, price) QUALIFY row_number() OVER w <= 10""")
def closest_per_store(spark, folder):
    return cleaning.closest_per_store(x1(spark, folder)).select(*KEY, F.col("closeness").cast("long").alias("closeness"))


@query("size_filter", f"""WITH {X1_HOLES}, {BAND}, {CLUSTER}, {MEMBERS} SELECT {KEYS}, size_kept, CASE WHEN NOT accepted OR strategy = 'NO SIZE DATA' THEN NULL
 WHEN set_aside THEN 'accepted; sold by weight (any quantity); size strategy=' || label
 WHEN size_ratio IS NULL THEN 'SIZE PEER REMOVED: unit-size ratio unavailable while sized peers exist'
 WHEN size_kept THEN 'accepted; size strategy=' || label || '; ratio=' || printf('%.2f', size_ratio)
 ELSE 'SIZE-DISTANT MATCH REMOVED: ratio=' || printf('%.2f', size_ratio) || '; strategy=' || label END AS size_reason
 FROM (SELECT *, CASE strategy WHEN 'PREFERRED' THEN 'PREFERRED 0.80-1.25x' WHEN 'CLOSE' THEN 'CLOSE 0.67-1.50x'
  WHEN 'FALLBACK' THEN 'FALLBACK NEAREST RETAIL SIZE around ' || printf('%.2f', anchor) || 'x' ELSE strategy END AS label FROM sz)""")
def size_filter(spark, folder):
    return cleaning.size_filter(x1_holes(spark, folder)).select(*KEY, "size_kept", "size_reason")


@query("near_duplicate", f"""WITH {X1} SELECT x.product_code, x.store, x.sku, x.price,
 x.sku = f.sku OR (abs(x.kg - f.kg) / greatest(x.kg, f.kg) <= 0.1::DOUBLE
 AND abs(x.price_per_kg - f.price_per_kg) / greatest(x.price_per_kg, f.price_per_kg) <= 0.15::DOUBLE) AS repeats_first
 FROM x JOIN (SELECT product_code, store, arg_min({{'sku': sku, 'kg': kg, 'price_per_kg': price_per_kg}}, (sku, price)) AS f FROM x GROUP BY 1, 2)
 USING (product_code, store)""")
def near_duplicate(spark, folder):
    """The pair test between each listing and the first listing of its product and store."""
    rows = x1(spark, folder)
    first = rows.groupBy(*cleaning.PRODUCT_STORE).agg(
        F.min(F.struct("sku", "price", "kg", F.col("price_per_kg").alias("u"))).alias("f"), F.count(F.lit(1)).alias("n"))
    word = F.array(F.lit("*"))
    one = F.struct("f.sku", "f.kg", "f.u", word.alias("toks"))
    other = F.struct("sku", "kg", F.col("price_per_kg").alias("u"), word.alias("toks"))
    joined = cleaning.attach(rows, first, cleaning.PRODUCT_STORE, "n")
    return joined.select(*KEY, cleaning.near_duplicate(one, other).alias("repeats_first"))


@query("dedupe_greedy", f"WITH RECURSIVE {X1}, {greedy('x', 'true')} SELECT {KEYS}, duplicate_of FROM d")
def dedupe_greedy(spark, folder):
    rows = x1(spark, folder).select(*KEY, "kg", "price_per_kg", F.lit(True).alias("accepted"))
    return cleaning.dedupe_greedy(rows).select(*KEY, "duplicate_of")


@query("outlier_band", f"WITH {X1}, {outliers('x', 'accepted')} SELECT {KEYS}, round(med + 3.7e-6, 4) AS median_price, off_band FROM o")
def outlier_band(spark, folder):
    return cleaning.outlier_tests(x1(spark, folder)).select(*KEY, r("median_price"), "off_band")


@query("outlier_mad", f"WITH {X1}, {outliers('x', 'accepted')} SELECT {KEYS}, round(z + 3.7e-6, 4) AS mad_z, off_mad FROM o")
def outlier_mad(spark, folder):
    return cleaning.outlier_tests(x1(spark, folder)).select(*KEY, r("mad_z"), "off_mad")


@query("clean_listings", f"{CLEAN} SELECT {KEYS}, status, duplicate_of FROM c")
def clean_listings(spark, folder):
    return cleaned_x1(spark, folder, *KEY, "status", "duplicate_of")


@query("cleaning_counts", f"""{CLEAN} SELECT product_code, store, count(*) FILTER (accepted) AS raw_accepted, count(*) FILTER (status = 'SIZE') AS size_removed,
 count(*) FILTER (status = 'DUPLICATE') AS duplicates, count(*) FILTER (status = 'OUTLIER') AS outliers,
 count(*) FILTER (status = 'ACCEPTED') AS accepted, count(*) FILTER (status <> 'ACCEPTED') AS rejected FROM c GROUP BY 1, 2""")
def cleaning_counts(spark, folder):
    return cleaning.cleaning_counts(cleaned_x1(spark, folder, *cleaning.PRODUCT_STORE, "status"))


@query("reason_codes", f"""{CLEAN} SELECT CASE status WHEN 'REJECTED' THEN NULL WHEN 'ACCEPTED' THEN 'OK' ELSE status END AS reason_code, count(*) AS n FROM c GROUP BY 1""")
def reason_codes(spark, folder):
    return flags.reason_counts(cleaned_x1(spark, folder, "reason_code"))


@query("reason_breakdown", f"""{CLEAN} SELECT status, count(*) AS n, count(DISTINCT product_code) AS products FROM c GROUP BY 1""")
def reason_breakdown(spark, folder):
    cleaned = cleaned_x1(spark, folder, "product_code", "status")
    return cleaning.reason_breakdown(cleaned)


@query("audit_union", f"""{CLEAN} SELECT product_code, store, sku, price, CASE WHEN status = 'ACCEPTED' THEN 'ACCEPTED' ELSE 'REJECTED' END AS verdict,
 round(price_per_kg + 3.7e-6, 4) AS price_per_kg FROM c""")
def audit_union(spark, folder):
    """Kept and rejected listings in one audit table: every candidate exactly once."""
    cleaned = cleaned_x1(spark, folder, *KEY, "price_per_kg", "status")
    verdict = F.when(F.col("status") == "ACCEPTED", "ACCEPTED").otherwise("REJECTED")
    return cleaned.select(*KEY, verdict.alias("verdict"), r("price_per_kg"))


@query("audit_by_product", f"""WITH {X1} SELECT product_code, store, count(*) AS listings, count(*) FILTER (accepted) AS accepted FROM x GROUP BY 1, 2""")
def audit_by_product(spark, folder):
    return tables.audit_by_product(x1(spark, folder))


@query("fresh_snapshot", f"""WITH {X1}, k AS (SELECT product_code, store, max(ts) AS ts FROM x WHERE ts > TIMESTAMP '2001-01-01' - INTERVAL 400 DAY AND ts <= TIMESTAMP '2001-01-01' GROUP BY 1, 2)
 SELECT x.product_code, x.store, x.ts, max(x.sku) AS sku FROM x JOIN k USING (product_code, store, ts) GROUP BY 1, 2, 3""")
def fresh_snapshot(spark, folder):
    fresh = tables.fresh_snapshot(x1(spark, folder), "2001-01-01 00:00:00", 400 * 24, ["product_code", "store"], "ts", "sku")
    return fresh.select("product_code", "store", "ts", "sku")


@query("percentile_linear", f"WITH {X1} SELECT product_code, round(quantile_cont(price_per_kg, 0.25) + 3.7e-6, 4) AS percentile FROM x GROUP BY 1")
def percentile_linear(spark, folder):
    return pricing.percentile_linear(x1(spark, folder), ["product_code"], "price_per_kg", 0.25).select("product_code", r("percentile"))


@query("price_level", f"""WITH {X1}, l AS (SELECT product_code, quantile_cont(price_per_kg, 0.25) AS economy, quantile_cont(price_per_kg, 0.5) AS median,
 avg(price_per_kg) AS average FROM x WHERE accepted GROUP BY 1) SELECT product_code, 'economy' AS level, round(economy + 3.7e-6, 4) AS level_price FROM l
 UNION ALL SELECT product_code, 'median', round(median + 3.7e-6, 4) FROM l UNION ALL SELECT product_code, 'average', round(average + 3.7e-6, 4) FROM l""")
def price_level(spark, folder):
    rows, out = clean_x1(spark, folder), None
    for level in ("economy", "median", "average"):
        one = pricing.price_level(rows, ["product_code"], PriceSettings(price_level=level)).select(
            "product_code", F.lit(level).alias("level"), r("level_price"))
        out = one if out is None else out.unionByName(one)
    return out


@query("store_stats", f"WITH {X1}, {STATS} SELECT product_code, store, round(average + 3.7e-6, 4) AS average, round(median + 3.7e-6, 4) AS median, round(economy + 3.7e-6, 4) AS economy, n FROM st")
def store_stats(spark, folder):
    return pricing.store_stats(clean_x1(spark, folder)).select("product_code", "store", r("average"), r("median"), r("economy"), "n")


@query("store_balanced", f"""WITH {X1}, {STATS}, {BALANCED} SELECT product_code, round(average + 3.7e-6, 4) AS average, round(economy + 3.7e-6, 4) AS economy,
 round(economy + 3.7e-6, 4) AS market, store_count, n FROM ba""")
def store_balanced(spark, folder):
    out = pricing.store_balanced(pricing.store_stats(clean_x1(spark, folder)))
    return out.select("product_code", r("average"), r("economy"), r("market"), "store_count", "n")


@query("all_candidates", f"""WITH {X1} SELECT product_code, round(avg(price_per_kg) + 3.7e-6, 4) AS average, round(quantile_cont(price_per_kg, 0.25) + 3.7e-6, 4) AS economy,
 round(quantile_cont(price_per_kg, 0.5) + 3.7e-6, 4) AS market, count(*) AS n FROM x WHERE accepted GROUP BY 1""")
def all_candidates(spark, folder):
    out = pricing.all_candidates(clean_x1(spark, folder), PriceSettings(price_level="median"))
    return out.select("product_code", r("average"), r("economy"), r("market"), "n")


@query("spread_stats", f"""WITH {X1}, {SPREAD} SELECT product_code, round(median + 3.7e-6, 4) AS median, round(min + 3.7e-6, 4) AS min, round(max + 3.7e-6, 4) AS max,
 round(ratio + 3.7e-6, 4) AS ratio, round(cv + 3.7e-6, 4) AS cv, n FROM sp""")
def spread_stats(spark, folder):
    return pricing.spread_stats(clean_x1(spark, folder)).select("product_code", r("median"), r("min"), r("max"), r("ratio"), r("cv"), "n")


@query("spread_ratio", f"WITH {X1}, {SPREAD} SELECT product_code, round(spread + 3.7e-6, 4) AS spread FROM sp")
def spread_ratio(spark, folder):
    return pricing.spread_stats(clean_x1(spark, folder)).select("product_code", r("spread"))


def _priced(spark, folder, price=pricing.market_levels):
    """Estimates of the accepted X1 listings with each product's target weight."""
    kg = fixtures.read(spark, folder, "part").select(F.col("p_partkey").alias("product_code"), F.col("p_size").cast("double").alias("target_kg"))
    return price(clean_x1(spark, folder)).join(kg, "product_code")


@query("estimate_price", f"""WITH {X1}, {STATS}, {BALANCED} SELECT product_code, round(ba.economy + 3.7e-6, 4) AS market, p_size::DOUBLE AS target_kg,
 round(ba.economy * p_size * 0.2 + 3.7e-6, 4) AS estimate FROM ba JOIN part ON p_partkey = product_code""")
def estimate_price(spark, folder):
    rows = _priced(spark, folder).withColumn("estimate", pricing.estimate_price(F.col("market"), F.col("target_kg")))
    return rows.select("product_code", r("market"), "target_kg", r("estimate"))


@query("min_max_estimate", f"""WITH {X1}, {SPREAD} SELECT product_code, round(min * p_size * 0.2 + 3.7e-6, 4) AS low, round(max * p_size * 0.2 + 3.7e-6, 4) AS high
 FROM sp JOIN part ON p_partkey = product_code""")
def min_max_estimate(spark, folder):
    both = pricing.min_max_estimate(F.col("min"), F.col("max"), F.col("target_kg"))
    return _priced(spark, folder, pricing.spread_stats).select("product_code", both.alias("e")).select(
        "product_code", near("e.low").alias("low"), near("e.high").alias("high"))


@query("market_per_kg", f"""WITH {X1}, {STATS}, {BALANCED} SELECT product_code, round(ba.economy + 3.7e-6, 4) AS market_per_kg FROM ba""")
def market_per_kg(spark, folder):
    rows = _priced(spark, folder).withColumn("estimate", pricing.estimate_price(F.col("market"), F.col("target_kg")))
    rows = rows.withColumn("m", pricing.market_per_kg(F.col("estimate"), F.col("target_kg"), F.lit(0.20)))
    return rows.select("product_code", near("m").alias("market_per_kg"))


TEXT = """tx AS (SELECT product_code, string_agg(store || '=$' || printf('%.2f', average) || '/kg (n=' || n || ')', ' | ' ORDER BY store DESC) AS store_averages,
 string_agg(store::VARCHAR, ', ' ORDER BY store DESC) AS stores_used, count(*) AS store_count FROM st GROUP BY 1)"""


@query("store_averages_text", f"WITH {X1}, {STATS}, {TEXT} SELECT * FROM tx")
def store_averages_text(spark, folder):
    rows = fixtures.listings(spark, folder, numbered=True).where("accepted")
    return pricing.store_averages_text(pricing.store_stats(rows), [3, 2, 1, 0])


@query("parse_store_counts", f"WITH {X1}, {STATS} SELECT product_code, store::VARCHAR AS store, n FROM st")
def parse_store_counts(spark, folder):
    return pricing.parse_store_counts(pricing.store_averages_text(pricing.store_stats(clean_x1(spark, folder)), [0, 1, 2, 3]))


@query("first_listing", f"""WITH {X1} SELECT product_code, store, l AS line, arg_min(sku, (page, sku)) AS sku, min(page) AS page
 FROM (SELECT *, (floor(price)::BIGINT % 5) AS l FROM x) GROUP BY 1, 2, 3""")
def first_listing(spark, folder):
    """Listings met again on later pages: the first page wins (five article lines per store stand in for the sku)."""
    rows = x1(spark, folder).withColumn("line", F.floor("price") % 5).withColumn("query_rank", F.lit(0))
    return candidates.first_listing(rows, ["product_code", "store", "line"], ["query_rank", "page", "sku"]).select(
        "product_code", "store", "line", "sku", "page")


PAGES = """pg AS (SELECT product_code, store, page, count(*) FILTER (accepted AND size_ratio BETWEEN 0.67::DOUBLE AND 1.5::DOUBLE) AS c, count(*) FILTER (accepted) AS g
  FROM x GROUP BY 1, 2, 3),
 rn AS (SELECT *, coalesce(sum(c) OVER w, 0) AS cb, coalesce(sum(g) OVER w, 0) AS gb FROM pg
  WINDOW w AS (PARTITION BY product_code, store ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("enough_evidence", f"""WITH {X1}, {PAGES} SELECT x.product_code, x.store, x.sku, x.price FROM x JOIN rn USING (product_code, store, page) WHERE cb < 2 AND gb < 4""")
def enough_evidence(spark, folder):
    rows = x1(spark, folder).withColumn("query_rank", F.lit(0))
    return candidates.enough_evidence(rows, PriceSettings(min_good_matches=2, raw_stop=4)).select(*KEY)


@query("deep_search", f"""WITH {X1}, pa AS (SELECT product_code, store, count(*) FILTER (accepted AND page <= 3) AS good FROM x GROUP BY 1, 2),
 q AS (SELECT x.*, page > 3 AS deep FROM x JOIN pa USING (product_code, store) WHERE page <= 3 OR good < 5),
 pg AS (SELECT product_code, store, deep, page, count(*) FILTER (accepted AND size_ratio BETWEEN 0.67::DOUBLE AND 1.5::DOUBLE) AS c, count(*) FILTER (accepted) AS g FROM q GROUP BY 1, 2, 3, 4),
 rn AS (SELECT *, coalesce(sum(c) OVER w, 0) AS cb, coalesce(sum(g) OVER w, 0) AS gb FROM pg
  WINDOW w AS (PARTITION BY product_code, store ORDER BY deep, page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 s1 AS (SELECT * FROM rn WHERE NOT deep AND cb < 5 AND gb < 10),
 k1 AS (SELECT product_code, store, sum(c) AS c1, sum(g) AS g1 FROM s1 GROUP BY 1, 2),
 s2 AS (SELECT rn.product_code, rn.store, rn.page, coalesce(c1, 0) + coalesce(sum(c) OVER w, 0) AS cb, coalesce(g1, 0) + coalesce(sum(g) OVER w, 0) AS gb, coalesce(g1, 0) AS g1
  FROM rn LEFT JOIN k1 USING (product_code, store) WHERE deep
  WINDOW w AS (PARTITION BY rn.product_code, rn.store ORDER BY rn.page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT q.product_code, q.store, q.sku, q.price, q.deep FROM q JOIN (SELECT product_code, store, page FROM s1 UNION ALL
  SELECT product_code, store, page FROM s2 WHERE g1 < 5 AND (page = (SELECT 4) OR (cb < 5 AND gb < 10))) USING (product_code, store, page)""")
def deep_search(spark, folder):
    rows = x1(spark, folder).withColumn("query_rank", F.lit(0))
    return candidates.deep_search(rows, 3).select(*KEY, "deep")


@query("choose_price", f"""WITH {X1} SELECT {KEYS}, round(CASE WHEN page > 2 THEN price WHEN discount > 0.05 THEN final_price ELSE price END + 3.7e-6, 4) AS chosen,
 CASE WHEN page > 2 THEN 'regular' WHEN discount > 0.05 THEN 'final fallback' ELSE 'listed' END AS basis FROM x""")
def choose_price_q(spark, folder):
    rows = x1(spark, folder)
    regular = F.when(F.col("page") > 2, F.col("regular_price"))
    final = F.when(F.col("discount") > 0.05, F.col("final_price"))
    choice = choose_price(regular, final, F.col("price"), F.lit("listed"))
    return rows.withColumn("c", choice).select(*KEY, near("c.price").alias("chosen"), F.col("c.basis").alias("basis"))


@query("unit_price", f"""WITH {X1} SELECT {KEYS}, CASE WHEN accepted AND page < 7 THEN round(price / kg + 3.7e-6, 4) END AS unit FROM x""")
def unit_price_q(spark, folder):
    rows = x1(spark, folder)
    kg = F.when(F.col("page") < 7, F.col("kg")).otherwise(F.lit(0.0))
    return rows.withColumn("unit", unit_price(F.col("price"), kg, F.col("accepted"))).select(*KEY, r("unit"))


@query("matching_count", f"WITH {X1} SELECT least(count(*) FILTER (store = 1 AND accepted), 5000) AS n FROM x")
def matching_count(spark, folder):
    return tables.matching_count(x1(spark, folder), [F.col("store") == 1, F.col("accepted")], 5000)


@query("manual_average", """WITH t AS (SELECT o_custkey AS product_code, CASE o_orderkey % 11 WHEN 0 THEN '' WHEN 1 THEN CASE WHEN o_custkey % 9 = 0 THEN 'x' ELSE ' ' END
 ELSE replace(printf('%.2f', o_totalprice), '.', ',') END AS typed, o_totalprice AS v FROM orders)
 SELECT product_code, count(*) FILTER (typed NOT IN ('', ' ', 'x')) AS stores, bool_or(typed = 'x') AS blocked,
 CASE WHEN NOT bool_or(typed = 'x') THEN floor((2 * sum(round(v * 100)::BIGINT) FILTER (typed NOT IN ('', ' ', 'x')) + count(*) FILTER (typed NOT IN ('', ' ', 'x')))
  / (2 * count(*) FILTER (typed NOT IN ('', ' ', 'x')))) / 100 END AS average FROM t GROUP BY 1""")
def manual_average(spark, folder):
    typed = (F.when(F.col("o_orderkey") % 11 == 0, "").when(F.col("o_orderkey") % 11 == 1, F.when(F.col("o_custkey") % 9 == 0, "x").otherwise(" "))
             .otherwise(F.translate(fixed(F.col("o_totalprice")), ".", ",")))
    rows = fixtures.read(spark, folder, "orders").select(F.col("o_custkey").alias("product_code"), typed.alias("typed"))
    return pricing.manual_average(rows, ["product_code"])

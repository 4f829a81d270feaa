"""Text, quantity and money functions over documents, pages and part-based names."""

from __future__ import annotations

from pyspark.sql import functions as F

from canasta.functions import money as M
from canasta.functions import quantity as Q
from canasta.functions import text as X
from canasta.plans.numeric import near
from canasta.operators.skew import spread
from canasta.plans.registry import query
from canasta.sources import fixtures, tables
from canasta.vocabulary import SPANISH as V
from canasta.vocabulary import FRESH_FAMILIES, UNITS


def lst(items) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]" + ("" if items else "::VARCHAR[]")


def within(items) -> str:
    return "(" + ", ".join(f"'{x}'" for x in items) + ")"


def norm(e: str, keep: str = ".") -> str:
    return f"trim(regexp_replace(replace(strip_accents(lower({e})), ',', '.'), '[^a-z0-9{keep}]+', ' ', 'g'))"


def unparen(e: str) -> str:
    return rf"regexp_replace({e}, '\([^)]*\)', ' ', 'g')"


U = "|".join(sorted(UNITS, key=len, reverse=True))
N = r"\d+(?:\.\d+)?"


def strip(e: str) -> str:
    """Names of these fixtures hold no broken decimals, so the quantity repair is left out."""
    e = norm(unparen(e), "./")
    for p in (rf"\b{N}\s*x\s*{N}\s*(?:{U})\b", rf"\b\d+\s*/\s*{N}\s*(?:{U})\b",
              rf"\b{N}\s*(?:{U}|unidades?|unid|unids|und|uds|docenas?|pack|pk|pck|un)\b", rf"\b{N}\s*[x/]\s*{N}\b", rf"\b{N}\b"):
        e = f"regexp_replace({e}, '{p}', ' ', 'g')"
    return rf"trim(regexp_replace(replace({e}, '/', ' '), '\s+', ' ', 'g'))"


ALIAS = "MAP {" + ", ".join(f"'{k}': '{x}'" for k, x in V.aliases.items()) + "}"
FEMININE = within([w[:-1] + "a" for w in V.gendered])
PLURAL = """CASE WHEN length(w) > 5 AND w LIKE '%ces' THEN left(w, length(w) - 3) || 'z'
 WHEN length(w) > 6 AND regexp_matches(w, '(ores|ales|oles|ones|anes)$') THEN left(w, length(w) - 2)
 WHEN length(w) > 4 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END"""


def canon(items: str) -> str:
    alias = f"coalesce({ALIAS}[w], w)"
    return (f"list_transform(list_transform(list_transform(list_transform({items}, lambda w: {alias}), lambda w: {PLURAL}), lambda w: {alias}), "
            f"lambda w: CASE WHEN w IN {FEMININE} THEN left(w, length(w) - 1) || 'o' ELSE w END)")


def raw_tokens(e: str) -> str:
    """Meaningful canonical words, repeats included."""
    kept = f"list_filter(list_transform(string_split({strip(e)}, ' '), lambda w: trim(w, '.')), lambda w: length(w) > 1 AND w NOT IN {within(V.stop)})"
    return f"list_filter({canon(kept)}, lambda t: t <> '' AND t NOT IN {within(V.stop)})"


def ordered(e: str) -> str:
    return f"list_filter({e}, lambda t, i: list_position({e}, t) = i)"


def minus(a: str, b: str) -> str:
    return f"list_filter({a}, lambda z: NOT list_contains({b}, z))"


def at(items: str, index: str) -> str:
    return f"{items}[(({index}) % len({items})) + 1]"


I7 = "(p_partkey * 7 + p_partkey // 12)"
NAMES = lst([t[0] for t in fixtures.TARGETS])
TITLE_LIST = lst(fixtures.TITLES)
TARGET = f"""tg AS (SELECT p_partkey AS product_code, p_partkey // 12 AS grp, {at(NAMES, I7)} || CASE p_partkey % 3 WHEN 0 THEN ' ' || p_size || 'g' WHEN 1 THEN ' ' || p_size || 'ml' ELSE '' END AS name,
 CASE WHEN p_partkey % 4 <> 0 THEN p_size / 40.0 END AS weight_kg, {at(lst([t[1] for t in fixtures.TARGETS]), I7)} AS line, {at(lst([t[2] for t in fixtures.TARGETS]), I7)} AS family,
 {at(lst([t[3] for t in fixtures.TARGETS]), I7)} AS category, p_size, p_partkey % 3 AS sz FROM part)"""
RETAIL = f"""rt AS (SELECT p_partkey % 4 AS store, p_partkey::VARCHAR AS sku, p_partkey // 12 AS grp,
 {at(TITLE_LIST, '(p_partkey * 5 + p_partkey // 12)')} || CASE p_partkey % 5 WHEN 0 THEN ' ' || p_size || 'g' WHEN 1 THEN ' ' || p_size || 'ml' WHEN 2 THEN ' ' || p_size || ' unidades' ELSE '' END AS title,
 CASE WHEN p_partkey % 6 <> 0 THEN p_retailprice / 100 END AS regular_price, CASE WHEN p_partkey % 10 <> 0 THEN p_retailprice / 110 END AS final_price,
 p_partkey % 3 AS att, p_partkey % 5 AS sz, p_size FROM part)"""


def pick_allowed(head: str, table: dict) -> str:
    return "CASE " + " ".join(f"WHEN {head} = '{k}' THEN {lst(x)}" for k, x in table.items()) + " ELSE []::VARCHAR[] END"


BLOB = "line || ' ' || family || ' ' || '' || ' ' || '' || ' ' || category"
FEATURES = f"""{TARGET}, tk0 AS (SELECT *, {raw_tokens('name')} AS r, {raw_tokens(BLOB)} AS b, {norm('family')} AS nfamily FROM tg),
 tk1 AS (SELECT *, {ordered('r')} AS tokens FROM tk0),
 tk2 AS (SELECT *, coalesce(list_sort(list_distinct(list_intersect(b, {pick_allowed('tokens[1]', V.context_modifiers)}))), []) AS mods FROM tk1),
 tk3 AS (SELECT *, list_concat(CASE WHEN nfamily IN {within(FRESH_FAMILIES)} THEN {minus('tokens', lst([*V.optional, 'entero']))}
   ELSE {minus('tokens', lst(V.optional))} END, mods) AS rq FROM tk2),
 tk4 AS (SELECT *, {ordered('rq')} AS req FROM tk3),
 tk5 AS (SELECT *, list_filter(req, lambda t: NOT (t IN {within(V.generic_optional)} AND len(req) > 1) {' '.join(f"AND NOT (t = '{w}' AND list_has_any(req, {lst(x)}))" for w, x in V.optional_with.items())}) AS ef FROM tk4),
 tf AS (SELECT *, CASE WHEN len(ef) > 0 THEN ef ELSE req END AS eff FROM tk5)"""


def texts(spark, folder):
    return spread(fixtures.read(spark, folder, "documents").select("doc_id", "text"))


@query("norm_text", f"SELECT doc_id, {norm('text')} AS text FROM documents")
def norm_text(spark, folder):
    return texts(spark, folder).select("doc_id", X.norm_text(F.col("text")).alias("text"))


@query("repair_mojibake", "SELECT doc_id, text FROM documents")
def repair_mojibake(spark, folder):
    """Every document is garbled (UTF-8 read as Latin-1, marked by a leading 'Ã©') and must come back unchanged."""
    broken = F.decode(F.encode(F.concat(F.lit("é"), F.col("text")), "UTF-8"), "ISO-8859-1")
    return texts(spark, folder).select("doc_id", F.substring(X.repair_mojibake(broken), 2, 2 ** 30).alias("text"))


@query("filter_contains", f"SELECT doc_id FROM documents WHERE contains({norm('text')}, 'ere le')")
def filter_contains(spark, folder):
    from canasta.operators.catalog import name_contains
    return name_contains(texts(spark, folder), "ÈRE, LE".replace(",", ""), "text").select("doc_id")


@query("strip_control", "SELECT page_id, regexp_replace(html || chr(3) || url || chr(127) || chr(9), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g') AS html FROM pages")
def strip_control(spark, folder):
    from canasta.operators.catalog import strip_control as clean
    dirty = F.concat("html", F.lit("\x03"), "url", F.lit("\x7f\t"))
    return clean(fixtures.read(spark, folder, "pages").select("page_id", dirty.alias("html")))


@query("drop_parens", rf"SELECT p_partkey AS product_code, {unparen("p_name || ' (' || p_type || ') ' || p_brand || '(x)'")} AS name FROM part")
def drop_parens(spark, folder):
    text = F.concat("p_name", F.lit(" ("), "p_type", F.lit(") "), "p_brand", F.lit("(x)"))
    return fixtures.read(spark, folder, "part").select(F.col("p_partkey").alias("product_code"), X.drop_parens(text).alias("name"))


@query("strip_quantities", f"""WITH {RETAIL} SELECT sku, {strip('title')} AS title FROM rt
 UNION ALL SELECT 'q' || p_partkey, ['leche', 'jugo x', 'helado', 'agua', 'soda pet', 'arroz', 'salami por media libra', 'escoba plastica', 'huevos',
  'te frio', 'tomate', 'pan'][p_partkey % 12 + 1] FROM part""")
def strip_quantities(spark, folder):
    a = fixtures.retail(spark, folder).select("sku", X.strip_quantities(F.col("title")).alias("title"))
    b = fixtures.quantity_text(spark, folder).select(F.concat(F.lit("q"), "product_code").alias("sku"), X.strip_quantities(F.col("text")).alias("title"))
    return a.unionByName(b)


WORDS = f"""{TARGET}, {RETAIL}, w AS (SELECT DISTINCT unnest(string_split({norm('text')}, ' ')) AS word FROM documents UNION SELECT unnest(string_split({norm('name')}, ' ')) FROM tg
 UNION SELECT unnest(string_split({norm('title')}, ' ')) FROM rt)"""


@query("canonical_word", f"WITH {WORDS} SELECT word, {canon('[word]')}[1] AS canonical FROM w")
def canonical_word(spark, folder):
    """Every distinct word of the documents, catalogue names and titles."""
    names = fixtures.catalog(spark, folder).select(F.col("name").alias("text"))
    titles = fixtures.retail(spark, folder).select(F.col("title").alias("text"))
    seen = texts(spark, folder).select("text").unionByName(names).unionByName(titles)
    words = seen.select(F.explode(F.split(X.norm_text(F.col("text")), " ")).alias("word")).distinct()
    return words.select("word", X.canonical_word(F.col("word")).alias("canonical"))


@query("semantic_tokens", f"WITH {RETAIL}, a AS (SELECT sku, {raw_tokens('title')} AS r FROM rt) SELECT sku, array_to_string({ordered('r')}, ' ') AS tokens FROM a")
def semantic_tokens(spark, folder):
    return fixtures.retail(spark, folder).select("sku", F.array_join(X.semantic_tokens(F.col("title")), " ").alias("tokens"))


@query("is_variety", f"WITH {TARGET} SELECT product_code, list_has_any(string_split({norm(unparen('name'))}, ' '), {lst(V.variety)}) AS variety FROM tg")
def is_variety(spark, folder):
    return fixtures.catalog(spark, folder).select("product_code", X.is_variety(F.col("name")).alias("variety"))


def target_rows(spark, folder):
    from canasta.operators.identity import target_features
    return target_features(fixtures.catalog(spark, folder))


@query("context_modifiers", f"WITH {FEATURES} SELECT product_code, array_to_string(mods, ' ') AS modifiers FROM tf")
def context_modifiers(spark, folder):
    return target_rows(spark, folder).select("product_code", F.array_join("t_mods", " ").alias("modifiers"))


@query("required_tokens", f"WITH {FEATURES} SELECT product_code, array_to_string(req, ' ') AS required FROM tf")
def required_tokens(spark, folder):
    return target_rows(spark, folder).select("product_code", F.array_join("t_req", " ").alias("required"))


@query("effective_required", f"WITH {FEATURES} SELECT product_code, array_to_string(eff, ' ') AS required FROM tf")
def effective_required(spark, folder):
    return target_rows(spark, folder).select("product_code", F.array_join("t_eff", " ").alias("required"))


SURFACE = {"limon": "limon", "vegetal": "vegetal"}
SEARCH = f"""{FEATURES}, sw AS (SELECT *, list_transform(req, lambda t: CASE WHEN t = 'entero' AND list_contains(string_split({norm('name')}, ' '), 'entera') THEN 'entera'
   WHEN t = 'saborizado' AND list_contains(string_split({norm('name')}, ' '), 'saborizada') THEN 'saborizada' ELSE t END) AS s FROM tf),
 im AS (SELECT *, list_filter(eff, lambda t: NOT (list_contains(req, 'muffin') AND t = 'pan')) AS red FROM sw),
 qs AS (SELECT product_code, req, CASE WHEN len(req) = 0 THEN []::VARCHAR[] WHEN len(req) = 1 THEN list_concat([s[1]],
    CASE req[1] WHEN 'embutido' THEN ['chorizo', 'jamon', 'mortadela', 'pepperoni', 'salami', 'salchicha'] WHEN 'hongo' THEN ['champinon'] ELSE []::VARCHAR[] END)
   ELSE list_concat([array_to_string(s[1:4], ' ')], CASE WHEN len(req) >= 3 THEN [s[1] || ' ' || s[-1], array_to_string(s[1:2], ' ')] ELSE []::VARCHAR[] END,
    CASE WHEN len(red) > 0 THEN [array_to_string(list_transform(red, lambda t: s[list_position(req, t)])[1:4], ' ')] ELSE []::VARCHAR[] END,
    CASE WHEN list_contains(eff, 'licuado') THEN [trim('colado ' || array_to_string(list_filter(eff, lambda t: t NOT IN ('licuado', 'bebe'))[1:3], ' '))] ELSE []::VARCHAR[] END) END AS q FROM im)"""


@query("search_queries", f"""WITH {SEARCH} SELECT product_code, array_to_string({ordered('q')}, '|') AS queries, CASE WHEN len(req) <= 1 THEN 'LOW'
 WHEN len(req) >= 3 OR list_has_any(req, {lst(V.identity)}) THEN 'HIGH' ELSE 'MEDIUM' END AS confidence,
 CASE WHEN len(req) = 0 THEN 'No usable identity words after removing size/packaging text'
  WHEN len(req) = 1 AND req[1] IN {within(V.generic_query)} THEN 'Generic one-word search; family/subtype guardrails and manual review recommended'
  WHEN len(req) = 1 THEN 'One-word search; manually review matches'
  WHEN len(req) >= 3 OR list_has_any(req, {lst(V.identity)}) THEN 'Strict identity validation requires: ' || array_to_string(req, ', ')
  ELSE 'Two-word query; strict candidate validation still requires both identity words' END AS warning FROM qs""")
def search_queries(spark, folder):
    return target_rows(spark, folder).select("product_code", F.array_join("t_search.queries", "|").alias("queries"),
                                             F.col("t_search.confidence").alias("confidence"), F.col("t_search.warning").alias("warning"))


@query("match_group", f"WITH {SEARCH} SELECT product_code, coalesce(q[1], '') AS match_group FROM qs")
def match_group(spark, folder):
    from canasta.operators.review import match_group as group
    rows = target_rows(spark, folder).select("product_code", F.array_join("t_search.queries", " | ").alias("queries"))
    return rows.select("product_code", group(F.col("queries")).alias("match_group"))


TWORDS = f"tw AS (SELECT sku, string_split({norm('title')}, ' ') AS w FROM rt), tc AS (SELECT sku, w, {canon('w')} AS c FROM tw)"
STATED = rf"length(w) > 1 AND w NOT IN {within(V.stop)} AND NOT regexp_matches(w, '^[\d.]+$')"


@query("token_positions", f"""WITH {RETAIL}, {TWORDS}, e AS (SELECT sku, unnest(w) AS w, unnest(c) AS c, generate_subscripts(w, 1) - 1 AS p FROM tc)
 SELECT sku, c AS token, min(p) AS position FROM e WHERE {STATED} GROUP BY 1, 2""")
def token_positions(spark, folder):
    return (fixtures.retail(spark, folder).select("sku", F.explode(X.token_positions(F.col("title"))).alias("e"))
            .select("sku", F.col("e.t").alias("token"), F.col("e.p").cast("long").alias("position")))


def implied_sql(own: str) -> str:
    parts = []
    for w, (implied, needs) in V.implies.items():
        test = f"list_contains({own}, '{w}')" + (f" AND list_has_any({own}, {lst(needs)})" if needs else "")
        parts.append(f"CASE WHEN {test} THEN [" + ", ".join(f"{{'t': '{x}', 'b': '{w}'}}" for x in implied) + "] ELSE [] END")
    fruit = [f for f in V.flavors if f not in V.not_fruit]
    parts.append(f"CASE WHEN list_contains({own}, 'concentrado') AND list_has_any({own}, {lst(fruit)}) THEN [{{'t': 'jugo', 'b': 'concentrado'}}] ELSE [] END")
    return "list_concat(" + ", ".join(parts) + ")"


LISTING = f"""{RETAIL}, lf0 AS (SELECT *, {raw_tokens('title')} AS r, string_split({norm('title')}, ' ') AS w FROM rt),
 lf1 AS (SELECT *, {ordered('r')} AS ord, {canon('w')} AS cw FROM lf0),
 lf2 AS (SELECT *, list_transform(cw, lambda c, i: CASE WHEN length(w[i]) > 1 AND w[i] NOT IN {within(V.stop)} AND NOT regexp_matches(w[i], '^[0-9.]+$') THEN c ELSE '' END) AS pt FROM lf1),
 lf3 AS (SELECT *, list_distinct(list_concat(list_filter(pt, lambda z: z <> ''), ord)) AS own FROM lf2),
 lf4 AS (SELECT *, {implied_sql('own')} AS imp FROM lf3),
 lf AS (SELECT *, list_transform(imp, lambda z: z.t) AS it, list_transform(imp, lambda z: z.b) AS ib,
  list_distinct(list_concat(own, list_transform(imp, lambda z: z.t))) AS toks,
  list_has_any(own, {lst(V.flavors)}) OR list_has_any(w, {lst(V.flavor_marks)}) AS flavored FROM lf4)"""


@query("implied_tokens", f"WITH {LISTING} SELECT sku, array_to_string(list_sort(list_distinct(it)), ' ') AS implied, array_to_string(list_sort(toks), ' ') AS tokens, flavored FROM lf")
def implied_tokens(spark, folder):
    from canasta.operators.identity import listing_features
    rows = listing_features(fixtures.retail(spark, folder)).withColumn("i", X.implied_words(F.col("l_own")))
    return rows.select("sku", F.array_join(F.array_sort(F.array_distinct(F.transform("i", lambda e: e["t"]))), " ").alias("implied"),
                       F.array_join(F.array_sort("l_tokens"), " ").alias("tokens"), F.col("l_flavor").alias("flavored"))


@query("token_jaccard", f"""WITH {FEATURES}, {RETAIL}, b2 AS (SELECT sku, grp, {raw_tokens('title')} AS r2 FROM rt), b3 AS (SELECT sku, grp, {ordered('r2')} AS o FROM b2)
 SELECT product_code, sku, CASE WHEN len(tokens) = 0 OR len(o) = 0 THEN 0 ELSE round(len(list_intersect(tokens, o)) / len(list_distinct(list_concat(tokens, o))) + 3.7e-6, 4) END AS jaccard
 FROM tf JOIN b3 USING (grp)""")
def token_jaccard(spark, folder):
    a = fixtures.catalog(spark, folder).select("product_code", "grp", X.semantic_tokens(F.col("name")).alias("a"))
    b = fixtures.retail(spark, folder).select("sku", "grp", X.semantic_tokens(F.col("title")).alias("b"))
    both = a.join(b, "grp").withColumn("j", X.token_jaccard(F.col("a"), F.col("b")))
    return both.select("product_code", "sku", F.when(F.col("j") > 0, near("j")).otherwise(F.col("j")).alias("jaccard"))


@query("fingerprint", f"WITH {RETAIL}, b2 AS (SELECT sku, p_size, {raw_tokens('title')} AS r2 FROM rt) SELECT sku, array_to_string(list_sort(list_distinct(r2)), ' ') AS tokens, round(p_size / 7.0::DOUBLE, 3) AS kg FROM b2")
def fingerprint(spark, folder):
    size = fixtures.read(spark, folder, "part").select(F.col("p_partkey").cast("string").alias("sku"), (F.col("p_size") / 7.0).alias("kg"))
    rows = fixtures.retail(spark, folder).join(size, "sku").withColumn("f", X.fingerprint(X.semantic_tokens(F.col("title")), F.col("kg")))
    return rows.select("sku", F.array_join("f.tokens", " ").alias("tokens"), F.col("f.kg").alias("kg"))


@query("product_url", """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'https://' || substr(url, 8) WHEN 1 THEN 'https://www.super99.com/p/' || page_id
 WHEN 2 THEN '' WHEN 3 THEN 'https://www.tienda.example/' || page_id WHEN 4 THEN url ELSE 'https://www.super99.com/s?q=ESPA%C3%91OL&n=' || page_id END AS link FROM pages""")
def product_url(spark, folder):
    """Six shapes of stored links: without scheme, relative, without store, bare host, complete, doubly encoded."""
    key, url = F.col("page_id"), F.col("url")
    raw = (F.when(key % 6 == 0, F.expr("substr(url, 6)")).when(key % 6 == 1, F.concat(F.lit("/p/"), key)).when(key % 6 == 2, F.concat(F.lit("/x/"), key))
           .when(key % 6 == 3, F.concat(F.lit("www.tienda.example/"), key)).when(key % 6 == 4, url)
           .otherwise(F.concat(F.lit("//www.super99.com/s?q=ESPA%C3%83%C2%91OL&n="), key)))
    store = F.when(key % 6 == 2, "unknown").otherwise(F.lit(" Super99"))
    return fixtures.read(spark, folder, "pages").select("page_id", X.product_url(raw, store).alias("link"))


@query("normalize_code", """SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN o_orderkey::VARCHAR WHEN 1 THEN o_orderkey || 'A' ELSE CASE WHEN o_totalprice = floor(o_totalprice)
 THEN o_totalprice::BIGINT::VARCHAR ELSE printf('%.2f', o_totalprice) END END AS code FROM orders""")
def normalize_code(spark, folder):
    key = F.col("o_orderkey")
    raw = F.when(key % 3 == 0, F.concat(key.cast("string"), F.lit(".0"))).when(key % 3 == 1, F.concat(F.lit(" "), key, F.lit("A "))).otherwise(M.fixed(F.col("o_totalprice")))
    return fixtures.read(spark, folder, "orders").select(key.alias("id"), M.normalize_code(raw).alias("code"))


@query("parse_money", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 6 THEN NULL WHEN o_orderkey % 7 IN (0, 1, 2, 3) THEN round(o_totalprice, 2) ELSE floor(o_totalprice) END AS amount,
 CASE WHEN o_orderkey % 7 = 6 THEN NULL WHEN o_orderkey % 7 IN (0, 2, 3) THEN round(o_totalprice, 2) WHEN o_orderkey % 7 = 1 THEN round(o_totalprice, 2)
  WHEN o_orderkey % 7 = 4 THEN floor(o_totalprice) ELSE floor(o_totalprice) END AS amount_comma FROM orders""")
def parse_money(spark, folder):
    """'$1,234.50', '1.234,50', '1234.50', ' $ 1234.50', whole numbers and words, read with both conventions."""
    key, v = F.col("o_orderkey") % 7, F.col("o_totalprice")
    us = F.format_number(v, 2)
    eu = F.translate(us, ",.", ".,")
    raw = (F.when(key == 0, F.concat(F.lit("$"), us)).when(key == 1, F.when(v >= 1000, eu).otherwise(M.fixed(v))).when(key == 2, M.fixed(v))
           .when(key == 3, F.concat(F.lit(" $ "), M.fixed(v))).when(key < 6, F.floor(v).cast("string"))
           .otherwise(F.when(F.col("o_orderkey") % 2 == 0, "NaN").otherwise("Infinity")))
    return fixtures.read(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), M.parse_money(raw).alias("amount"),
                                                         M.parse_money(raw, True).alias("amount_comma"))


@query("repair_decimals", """SELECT p_partkey AS product_code, CASE WHEN p_partkey % 3 = 0 THEN 'jugo 1.89l' WHEN p_partkey % 10 = 5 OR p_size % 10 IN (0, 1)
 THEN 'jugo ' || (p_size % 10) || '.' || (p_partkey % 10) || 'lt' ELSE 'jugo ' || (p_size % 10) || '/' || (p_partkey % 10) || 'lt' END AS text FROM part""")
def repair_decimals(spark, folder):
    key = F.col("p_partkey")
    raw = F.when(key % 3 == 0, "Jugo 1 89L").otherwise(F.concat(F.lit("Jugo "), (F.col("p_size") % 10).cast("string"), F.lit(" "), (key % 10).cast("string"), F.lit(" LT")))
    return fixtures.read(spark, folder, "part").select(key.alias("product_code"), X.repair_decimals(raw).alias("text"))


SIZES = """x3 AS (SELECT p_partkey AS product_code, p_partkey % 12 AS k, p_size AS n, CASE p_partkey % 12 WHEN 0 THEN p_size * 0.17::DOUBLE WHEN 1 THEN p_size * 0.006::DOUBLE WHEN 2 THEN 3.785411784 / 2
  WHEN 3 THEN p_size / 1000.0 WHEN 4 THEN 2 WHEN 5 THEN p_size WHEN 6 THEN 0.45359237 / 2 WHEN 9 THEN p_size * 0.006::DOUBLE WHEN 10 THEN 1 END::DOUBLE AS total,
 CASE p_partkey % 12 WHEN 0 THEN 0.17 WHEN 1 THEN p_size / 1000.0 WHEN 2 THEN 3.785411784 / 2 WHEN 3 THEN p_size / 1000.0 WHEN 4 THEN 2 WHEN 5 THEN p_size WHEN 6 THEN 0.45359237 / 2
  WHEN 9 THEN p_size / 1000.0 WHEN 10 THEN 1 END::DOUBLE AS unit,
 CASE p_partkey % 12 WHEN 0 THEN p_size || ' x 170g' WHEN 1 THEN p_size || 'ml x 6' WHEN 2 THEN 'fraction 1/2 gl' WHEN 3 THEN 'unit size from slash-pack 24/' || p_size || 'ml'
  WHEN 4 THEN 'unit size from slash-pack 6/2lt; read ''6 2lt'' as case pack 6/2lt' WHEN 5 THEN p_size || ' kg' WHEN 6 THEN 'implicit half pound from ''media libra'''
  WHEN 9 THEN '6 x ' || p_size || 'ml (multipack ''6 pack'')' WHEN 10 THEN 'implicit 1kg from ''kilo''' ELSE 'no mass/volume in candidate name' END AS note, p_partkey % 5 AS att FROM part)"""


@query("parse_quantity", f"WITH {SIZES} SELECT product_code, round(total + 3.7e-8, 6) AS total_kg, round(unit + 3.7e-8, 6) AS unit_kg, note FROM x3")
def parse_quantity(spark, folder):
    rows = fixtures.quantity_text(spark, folder).select("product_code", F.inline(F.array(Q.parse_quantity(F.col("text")))))
    return rows.select("product_code", near("total_kg", 6).alias("total_kg"), near("unit_kg", 6).alias("unit_kg"), "note")


@query("parse_count", f"""WITH {SIZES} SELECT product_code, CASE WHEN k = 8 THEN n WHEN k = 11 THEN n * 12 END::DOUBLE AS strict,
 CASE WHEN k = 8 THEN n WHEN k = 11 THEN n * 12 WHEN total IS NOT NULL THEN 1 END::DOUBLE AS loose FROM x3""")
def parse_count(spark, folder):
    rows = fixtures.quantity_text(spark, folder)
    return rows.select("product_code", Q.parse_count(F.col("text"))["n"].alias("strict"), Q.parse_count(F.col("text"), True)["n"].alias("loose"))


@query("target_count", f"""WITH {SIZES} SELECT product_code, CASE WHEN k = 8 THEN n WHEN k = 11 THEN n * 12 END::DOUBLE AS pieces, (n * (10 + n))::DOUBLE AS grid FROM x3""")
def target_count(spark, folder):
    rows = fixtures.quantity_text(spark, folder)
    grid = F.concat(F.lit("Vasos "), F.col("n"), F.lit("x"), F.col("n") + 10, F.lit(" (2x99)"))
    return rows.select("product_code", Q.target_count(F.col("text"))["n"].alias("pieces"), Q.target_count(grid)["n"].alias("grid"))


@query("quantity_basis", f"WITH {SIZES} SELECT product_code, CASE WHEN k IN (8, 11) THEN 'count' ELSE 'mass' END AS basis, CASE WHEN n % 2 = 0 THEN 'count' ELSE 'mass' END AS sized FROM x3")
def quantity_basis(spark, folder):
    rows = fixtures.quantity_text(spark, folder)
    sized = F.concat(F.lit("Vasos 9oz "), F.col("n"), F.lit("und"))
    category = F.when(F.col("n") % 2 == 0, "No Alimento").otherwise("Alimento")
    basis = lambda t, c: Q.quantity_basis(Q.target_count(t)["n"], Q.parse_quantity(t)["total_kg"], c)
    return rows.select("product_code", basis(F.col("text"), F.lit("")).alias("basis"), basis(sized, category).alias("sized"))


@query("sold_by_weight", f"""WITH {SIZES} SELECT product_code, CASE product_code % 7 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN n WHEN 3 THEN 1 WHEN 4 THEN 1 END::DOUBLE AS kg,
 CASE product_code % 7 WHEN 2 THEN 'sold by weight (price per ' || n || ' kg)' WHEN 4 THEN 'sold by weight (price per kg; weighed stock)' WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE 'sold by weight (price per kg)' END AS source FROM x3""")
def sold_by_weight(spark, folder):
    k, n = F.col("product_code") % 7, F.col("n").cast("string")
    pair = lambda *kv: F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in kv])
    attrs = (F.when(k == 0, pair("sales_unit_of_measure", "Kilogramo")).when(k == 1, pair("unit", "kg")).when(k == 2, pair("measurement unit", "KG", "unit multiplier", n))
             .when(k == 3, pair("size", "KG")).when(k == 4, pair("size", "0.58 KG", "inventory", "12.30")).when(k == 5, pair("size", "0.58 KG", "inventory", "12.00"))
             .otherwise(pair("unit", "kg", "sub unit", "lb")))
    return fixtures.quantity_text(spark, folder).select("product_code", Q.sold_by_weight(attrs).alias("w")).select(
        "product_code", F.col("w.kg").alias("kg"), F.col("w.source").alias("source"))


@query("candidate_quantity", f"""WITH {SIZES} SELECT product_code, round(CASE WHEN att = 0 THEN 1 WHEN total IS NOT NULL THEN total WHEN att = 1 THEN n / 1000.0 END + 3.7e-8, 6)::DOUBLE AS kg,
 CASE WHEN att = 0 THEN 'sold by weight (price per kg)' WHEN total IS NOT NULL THEN note WHEN att = 1 THEN 'attribute size: ' || n || 'g' ELSE note END AS source FROM x3""")
def candidate_quantity(spark, folder):
    rows = fixtures.quantity_text(spark, folder).select("product_code", Q.candidate_quantity(F.col("text"), F.col("attrs")).alias("q"))
    return rows.select("product_code", near("q.kg", 6).alias("kg"), F.col("q.source").alias("source"))


@query("target_quantity", f"""WITH {SIZES} SELECT product_code, round(CASE WHEN k = 8 THEN n WHEN k = 11 THEN n * 12 WHEN total IS NOT NULL THEN total WHEN n % 3 = 0 THEN NULL ELSE n / 4.0 END + 3.7e-8, 6)::DOUBLE AS kg,
 CASE WHEN k = 8 THEN 'count basis: ' || n || ' units (prices are per unit)' WHEN k = 11 THEN 'count basis: ' || n * 12 || ' units (' || n || ' docenas) (prices are per unit)'
  WHEN total IS NOT NULL THEN note WHEN n % 3 = 0 THEN 'target quantity unavailable' ELSE 'Unidad de Peso en KG' END AS source FROM x3""")
def target_quantity(spark, folder):
    rows = fixtures.quantity_text(spark, folder).withColumns({"c": Q.target_count(F.col("text")), "s": Q.parse_quantity(F.col("text"))})
    sheet = F.when(F.col("n") % 3 == 0, F.lit(0.0)).otherwise(F.col("n") / 4.0)
    basis = Q.quantity_basis(F.col("c.n"), F.col("s.total_kg"), F.lit(""))
    rows = rows.select("product_code", Q.target_quantity(basis, F.col("c"), F.col("s"), sheet).alias("q"))
    return rows.select("product_code", near("q.kg", 6).alias("kg"), F.col("q.source").alias("source"))


@query("size_ratio", f"WITH {SIZES} SELECT product_code, CASE WHEN unit > 0 AND n % 4 > 0 THEN round(unit / (n % 4) + 3.7e-8, 6) END AS ratio FROM x3")
def size_ratio(spark, folder):
    rows = fixtures.quantity_text(spark, folder).withColumn("u", Q.parse_quantity(F.col("text"))["unit_kg"])
    rows = rows.withColumn("ratio", Q.size_ratio((F.col("n") % 4).cast("double"), F.col("u")))
    return rows.select("product_code", near("ratio", 6).alias("ratio"))


@query("quantity_kind", f"WITH {SIZES} SELECT product_code, CASE WHEN k IN (1, 2, 3, 4, 9) THEN 'volume' WHEN k IN (0, 5) THEN 'mass' END AS kind FROM x3")
def quantity_kind(spark, folder):
    return fixtures.quantity_text(spark, folder).select("product_code", Q.quantity_kind(F.col("text")).alias("kind"))


@query("dimensions", f"WITH {SIZES} SELECT product_code, CASE WHEN n % 2 = 0 THEN least(7, n) || 'x' || greatest(7, n) END AS dims FROM x3")
def dimensions(spark, folder):
    rows = fixtures.quantity_text(spark, folder)
    text = F.when(F.col("n") % 2 == 0, F.concat(F.lit('Caja 7" x '), F.col("n"), F.lit('" 50 unid'))).otherwise(F.concat(F.lit("Atun "), F.col("n"), F.lit(" x 17g")))
    d = Q.dimensions(text)
    return rows.select("product_code", F.when(d.isNotNull(), F.concat_ws("x", F.get(d, F.lit(0)).cast("string"), F.get(d, F.lit(1)).cast("string"))).alias("dims"))


@query("quantity_warning", f"""WITH {SIZES}, s AS (SELECT *, n / 8.0::DOUBLE AS sheet FROM x3) SELECT product_code,
 CASE WHEN k NOT IN (8, 11) AND total IS NOT NULL AND greatest(total, sheet) / least(total, sheet) >= 1.15::DOUBLE AND NOT (sheet / total > 1 AND sheet / total <= 1.5::DOUBLE) THEN 'warning'
  WHEN k NOT IN (8, 11) AND total IS NOT NULL AND sheet / total >= 1.15::DOUBLE AND sheet / total <= 1.5::DOUBLE THEN 'note' ELSE '' END AS verdict,
 CASE WHEN verdict = 'warning' THEN 'TARGET SIZE WARNING: name parses to ' || printf('%.3f', total) || 'kg but spreadsheet weight is ' || printf('%.3f', sheet) || 'kg'
  WHEN verdict = 'note' THEN 'Spreadsheet weight ' || printf('%.3f', sheet) || 'kg vs ' || printf('%.3f', total) || 'kg in the name (probably includes packaging; the name is used)' ELSE '' END AS text FROM s""")
def quantity_warning(spark, folder):
    rows = fixtures.quantity_text(spark, folder).withColumns({"c": Q.target_count(F.col("text")), "s": Q.parse_quantity(F.col("text"))})
    basis = Q.quantity_basis(F.col("c.n"), F.col("s.total_kg"), F.lit(""))
    rows = rows.withColumn("w", Q.quantity_warning(basis, F.col("s.total_kg"), F.col("n") / 8.0))
    verdict = F.when(F.col("w.warning") != "", "warning").when(F.col("w.note") != "", "note").otherwise("")
    return rows.select("product_code", verdict.alias("verdict"), F.concat("w.warning", "w.note").alias("text"))

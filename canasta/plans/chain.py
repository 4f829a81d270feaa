"""The whole way as queries: price run, review list, decisions, export."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from canasta.operators.skew import cut
from canasta.plans import review_run
from canasta.plans.matching import RUN, priced_sql, whole_run
from canasta.plans.registry import query
from canasta.plans.reviewing import GRADE, REPLAY, STEPS, VALID_STEPS
from canasta.plans.texts import lst
from canasta.sources import fixtures
from canasta.vocabulary import SPANISH as V

_TABLES = priced_sql(RUN)
_REPLAY = re.sub(r"\b([owfu])\b", r"r\1", REPLAY)        # names that the run's tables have too
ITEMS = _TABLES[:_TABLES.index("\n SELECT tg.product_code")] + f""", su AS (SELECT product_code, sum(least(k, 3))::BIGINT AS support FROM (SELECT product_code, store, count(*) AS k FROM c WHERE status = 'ACCEPTED' GROUP BY 1, 2) GROUP BY 1),
 ir AS (SELECT tg.product_code, coalesce(ct.n, 0) AS n, coalesce(ba.store_count, 0) AS store_count, coalesce(support, 0) AS support, ba.economy * (tg.p_size / 1000.0::DOUBLE) * 0.2::DOUBLE AS estimate, sp.cv,
   CASE WHEN len(req) <= 1 THEN 'LOW' WHEN len(req) >= 3 OR list_has_any(req, {lst(V.identity)}) THEN 'HIGH' ELSE 'MEDIUM' END AS confidence, '' AS request_error,
   CASE WHEN p_partkey % 10 <> 0 THEN p_retailprice * 10 / 20000.0::DOUBLE END AS current_price, CASE WHEN p_partkey % 7 <> 0 THEN 'ID' || p_partkey ELSE '' END AS id
  FROM tg LEFT JOIN ct USING (product_code) LEFT JOIN ba USING (product_code) LEFT JOIN sp USING (product_code) LEFT JOIN su USING (product_code) LEFT JOIN qs USING (product_code) JOIN part ON p_partkey = tg.product_code),
 it AS (SELECT *, coalesce(nullif(concat_ws(' | ', CASE WHEN n = 0 THEN 'NO MATCHES' WHEN n <= 2 THEN 'VERY HIGH RISK: only ' || n || ' clean match(es)' WHEN n < 5 THEN 'HIGH RISK: only ' || n || ' clean match(es); need 5' END,
   CASE WHEN store_count = 1 THEN 'ONE STORE ONLY' END, CASE WHEN confidence = 'LOW' AND (n < 5 OR store_count < 2) THEN 'LOW SEARCH CONFIDENCE' END), ''), 'OK') AS quality FROM ir)"""


def items(spark, folder):
    """The review list of the whole run against current prices of its scale, written once."""
    prices = fixtures.current_prices(spark, folder).withColumn("current_price", F.col("current_price") / 20000.0)
    return cut(review_run.review_items(*whole_run(spark, folder), prices).drop("flags"), "review")


@query("run_review", f"{ITEMS}, {GRADE} SELECT product_code, n, store_count, support::BIGINT AS support, confidence, quality, score, points FROM gr")
def run_review(spark, folder):
    """Score and points of every product of the whole run."""
    return items(spark, folder).select("product_code", "n", "store_count", "support", "confidence", "quality", "score", "points")


@query("run_export", f"""{ITEMS}, {STEPS}, {VALID_STEPS.replace("JOIN it USING", "JOIN (SELECT * FROM it WHERE id <> '') it USING")}, {_REPLAY}, ls AS (SELECT product_code, arg_max({{'a': action, 'p': price}}, seq) AS d FROM lg JOIN ru USING (session_id, seq) GROUP BY 1)
 SELECT id AS "Id", printf('%.2f', CASE d.a WHEN 'manual' THEN d.p ELSE CASE WHEN round(estimate, 2) > 0 THEN estimate ELSE current_price END END) AS "UnitPrice" FROM it JOIN ls USING (product_code) WHERE d.a IN ('accepted', 'manual') AND id <> ''""")
def run_export(spark, folder):
    """The approved prices of the whole run after the decisions of all sessions, for products that have an export id."""
    ready = items(spark, folder).where(F.col("id") != "").drop("price")
    return review_run.approved_lines(ready, fixtures.steps(spark, folder))

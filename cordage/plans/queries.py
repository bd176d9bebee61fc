"""The queries of the driver contract: each operator on the test tables, and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels as show
from ..functions import values as val
from ..operators import costs, facets, fees, links, lookup, merge, near, state, texts, upsert, validate
from ..sources import records, schema
from ..sources.scratch import shared_folder
from ..sources.merge_on_read import MergeTable
from ..sources.substrings import SubstringIndex
from ..sources.versions import VersionedTable
from .ingest import ingest, quarantined, recover, split

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def _query(sql: str):
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        _sql[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Filters


@_query("""SELECT c_custkey, c_mktsegment, c_nationkey, c_acctbal FROM customer
WHERE c_mktsegment = 'BUILDING' AND c_acctbal / 1000 <= 5 AND c_nationkey <= 10""")
def facet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
    return facets.facet_filter(rows, {"c_mktsegment": "BUILDING"}, ("c_acctbal", 5), ("c_nationkey", "Within 10 km"))


@_query("SELECT c_custkey, c_mktsegment, c_nationkey, c_acctbal FROM customer WHERE c_acctbal / 1000 <= 5")
def facet_filter_inactive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
    return facets.facet_filter(rows, {"c_mktsegment": "All Segments"}, ("c_acctbal", 5), ("c_nationkey", "Anywhere"))


@_query("SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring')")
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.text_search(_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), "Ring", ["p_name", "p_brand"])


_SEARCHES = ["Ring", "small ", "ed p", "ld", "no such part"]


@_query(" UNION ALL ".join(f"SELECT '{q}' AS query, p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name), lower('{q}')) OR contains(lower(p_brand), lower('{q}'))" for q in _SEARCHES))
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by several queries, through one index."""
    index = SubstringIndex(spark, _new_folder(spark, "substrings"), ["p_name", "p_brand"], parts=64, buckets=16)
    index.build(_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"))
    return reduce(DataFrame.union, (index.search(q).select(F.lit(q).alias("query"), "p_partkey", "p_name", "p_brand") for q in _SEARCHES))


@_query("SELECT event_id, user_id, event_type, value FROM events WHERE event_type = 'click'")
def category_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.category_filter(_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), "event_type", "click")


@_query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def status_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.status_gate(_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderstatus", "F")


@_query("SELECT count(*) AS n_matches FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal / 1000 <= 5 AND c_nationkey <= 10")
def match_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.match_count(facet_filter(spark, sf_dir))


# Lookups and joins


@_query("SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey = 7")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.point_lookup(_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), "s_suppkey", 7)


@_query("""WITH d AS (SELECT quality, toxic FROM labels ORDER BY doc_id LIMIT 1)
SELECT t.doc_id, CASE WHEN l.doc_id IS NULL THEN (SELECT quality FROM d) ELSE l.quality END AS quality,
       CASE WHEN l.doc_id IS NULL THEN (SELECT toxic FROM d) ELSE l.toxic END AS toxic
FROM documents t LEFT JOIN labels l ON t.doc_id = l.doc_id""")
def lookup_default_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.lookup_or_default(_table(spark, sf_dir, "documents").select("doc_id"), _table(spark, sf_dir, "labels"), "doc_id")


@_query("SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey IN (42, 3, 7)")
def compare_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.compared(_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), "s_suppkey", [42, 3, 7])


@_query("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 1 OFFSET 2")
def position_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.at_position(_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), ["n_nationkey"], 3)


@_query("SELECT o_orderkey, o_totalprice, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def post_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), _table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return lookup.navigate(orders, customers, "o_custkey", "c_custkey").select("o_orderkey", "o_totalprice", "c_name")


@_query("""WITH f AS (SELECT d.doc_id, min(b.item_id) AS item_id FROM documents d JOIN benchmark b
  ON contains(lower(d.text), lower(b.text)) OR contains(lower(b.text), lower(d.text)) GROUP BY d.doc_id),
g AS (SELECT f.item_id, max(d.doc_id) AS matched_record,
      max_by(d.source, CASE WHEN d.source <> '' AND lower(d.source) <> 'unclear' THEN d.doc_id END) FILTER (WHERE d.source <> '' AND lower(d.source) <> 'unclear') AS s,
      max_by(d.n_chars, d.doc_id) FILTER (WHERE d.n_chars IS NOT NULL) AS n FROM f JOIN documents d USING (doc_id) GROUP BY f.item_id)
SELECT b.item_id, coalesce(g.s, 'seed') AS curriculum, coalesce(g.n, -1) AS tuition_start, g.matched_record
FROM benchmark b LEFT JOIN g USING (item_id)""")
def containment_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalogue = _table(spark, sf_dir, "benchmark").withColumns({"curriculum": F.lit("seed"), "tuition_start": F.lit(-1).cast("long")})
    records = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("name"), "source", "n_chars")
    merged = merge.merge_records(catalogue, records, "item_id", "text", "doc_id", "name", {"curriculum": "source"}, {"tuition_start": "n_chars"})
    return merged.select("item_id", "curriculum", "tuition_start", "matched_record")


@_query("""WITH batch AS (SELECT s_suppkey AS seq, CASE s_suppkey % 3 WHEN 0 THEN upper(s_name) WHEN 1 THEN 'New ' || s_name ELSE lower(s_name) END AS s_name, s_acctbal + 1 AS s_acctbal FROM supplier
  UNION ALL SELECT s_suppkey + (SELECT max(s_suppkey) FROM supplier), CASE WHEN s_suppkey % 2 = 0 THEN lower(s_name) ELSE 'Other ' || s_name END, 0.5 FROM supplier),
last AS (SELECT s_name, s_acctbal FROM batch QUALIFY row_number() OVER (PARTITION BY lower(s_name) ORDER BY seq DESC) = 1)
SELECT s_name, s_acctbal FROM supplier WHERE lower(s_name) NOT IN (SELECT lower(s_name) FROM last) UNION ALL SELECT s_name, s_acctbal FROM last""")
def upsert_anti_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    k = F.col("s_suppkey")
    first = F.when(k % 3 == 0, F.upper("s_name")).when(k % 3 == 1, F.concat(F.lit("New "), "s_name")).otherwise(F.lower("s_name"))
    second = F.when(k % 2 == 0, F.lower("s_name")).otherwise(F.concat(F.lit("Other "), "s_name"))
    last = base.agg(F.max("s_suppkey")).first()[0] or 0
    batch = base.select(k.alias("seq"), first.alias("s_name"), (F.col("s_acctbal") + 1).alias("s_acctbal")).unionByName(base.select((k + last).alias("seq"), second.alias("s_name"), F.lit(0.5).alias("s_acctbal")))
    return upsert.upsert(base.drop("s_suppkey"), batch, "s_name", "seq")


# Costs: the lines of an order are its tiers, and its costs by return flag

_LINES = """l AS (SELECT l_orderkey AS k, l_linenumber AS ln, cast(floor(l_extendedprice + 0.5) AS BIGINT) AS price, l_partkey AS pk, l_suppkey AS sk,
  l_returnflag AS flag, l_linestatus AS st, cast(l_quantity AS BIGINT) AS qty FROM lineitem),
r AS (SELECT k, list({'ln': ln, 'price': price, 'pk': pk, 'sk': sk, 'flag': flag, 'st': st, 'qty': qty} ORDER BY ln, price, pk, sk, flag, st, qty) AS a FROM l GROUP BY k)"""


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``k`` and ``a``: the lines of each order in an order that no tie leaves open."""
    rows = _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ln"), val.half_up(F.col("l_extendedprice")).alias("price"), F.col("l_partkey").alias("pk"),
        F.col("l_suppkey").alias("sk"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("st"), F.col("l_quantity").cast("bigint").alias("qty"),
    )
    return rows.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("ln", "price", "pk", "sk", "flag", "st", "qty"))).alias("a"))


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records."""
    none = lambda kind: F.lit(None).cast(kind)
    tier = lambda x: F.struct(F.concat(F.lit("Line "), x["ln"].cast("string")).alias("grade_level"), x["price"].alias("annual_thb"), none("bigint").alias("semester_thb"), none("string").alias("notes"))
    name = lambda x: F.when(x["flag"] == "A", "Application fee").when(x["flag"] == "R", "Refundable deposit").otherwise(F.concat(F.lit("Lunch "), x["st"]))
    notes = lambda x: F.when(x["st"] == "F", "per semester").when(x["qty"] < 10, "one-time").otherwise("per year")
    cost = lambda x: F.struct(name(x).alias("name"), (x["qty"] * 100).alias("amount_thb"), notes(x).alias("notes"))
    return order_lines(spark, sf_dir).select(
        F.concat(F.lit("Order "), F.col("k").cast("string")).alias("school_name"), F.transform("a", tier).alias("tuition_by_grade"),
        F.transform("a", cost).alias("hidden_costs"), none("bigint").alias("tuition_min_thb"), none("bigint").alias("tuition_max_thb"),
    )


SCENARIOS = [costs.Scenario(0, 6, (), "first_child", 0), costs.Scenario(2, 15, None, "first_child", 10)]

_COSTED = f"""WITH {_LINES}, s AS (SELECT * FROM (VALUES (0, 0, 6, 0, false), (1, 2, 15, 10, true)) t(scenario, start, years, pct, addons)),
c AS (SELECT k, scenario, years, pct, a, len(a) AS n, least(start, len(a) - 1) AS first,
  coalesce(list_filter(a, lambda x: x.flag = 'A')[1].qty * 100, 0) AS app, coalesce(list_filter(a, lambda x: x.flag = 'R')[1].qty * 100, 0) AS dep,
  list_filter(a, lambda x: addons AND x.flag NOT IN ('A', 'R')) AS ads FROM r, s),
d AS (SELECT *, app + dep + coalesce(list_sum(list_transform(ads, lambda x: CASE WHEN x.st <> 'F' AND x.qty < 10 THEN x.qty * 100 ELSE 0 END)), 0) AS once,
  coalesce(list_sum(list_transform(ads, lambda x: CASE WHEN x.st = 'F' THEN x.qty * 200 WHEN x.qty < 10 THEN 0 ELSE x.qty * 100 END)), 0) AS ann FROM c),
y AS (SELECT *, unnest(range(0, years)) AS y FROM d),
sch AS (SELECT 'Order ' || k AS school_name, scenario, k, cast(y + 1 AS INTEGER) AS year, 'Line ' || a[least(first + y, n - 1) + 1].ln AS grade,
  CASE WHEN a[least(first + y, n - 1) + 1].price = 0 THEN 500000 ELSE a[least(first + y, n - 1) + 1].price END AS tuition, pct, years,
  cast(CASE WHEN y = 0 THEN once ELSE 0 END AS BIGINT) AS one_time, cast(ann AS BIGINT) AS addons, app, dep, once, a, n, first, ads FROM y),
f AS (SELECT *, cast(CASE WHEN pct > 0 THEN floor(tuition * (pct / 100) + 0.5) ELSE 0 END AS BIGINT) AS off FROM sch)"""


@_query(f"{_COSTED} SELECT school_name, scenario, year, grade, tuition AS tuition_thb, one_time AS one_time_thb, addons AS addons_thb, off AS discount_thb, tuition - off + addons + one_time AS total_thb FROM f")
def cost_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return costs.cost_schedule(costs.project(order_records(spark, sf_dir), SCENARIOS))


@_query(f"""{_COSTED},
g AS (SELECT school_name, scenario, years, cast(sum(tuition) AS BIGINT) AS t, cast(sum(off) AS BIGINT) AS o, any_value(addons) AS ann, cast(any_value(once) AS BIGINT) AS once, any_value(app + dep) AS fees,
      cast(sum(CASE WHEN year = 1 THEN tuition - off + addons + one_time END) AS BIGINT) AS y1 FROM f GROUP BY ALL),
h AS (SELECT *, t - o + ann * years + once AS j, ann * years + once - fees AS ad, cast(floor((t - o + ann * years + once) / years + 0.5) AS BIGINT) AS av FROM g)
SELECT school_name, scenario, j AS journey_thb, y1 AS year1_thb, av AS average_thb, cast(floor(av / 12 + 0.5) AS BIGINT) AS month_thb, once AS one_time_thb, t AS tuition_thb,
  cast(ad AS BIGINT) AS addons_thb, o AS discount_thb, CASE WHEN j > 0 THEN cast(floor(t / j * 100 + 0.5) AS BIGINT) END AS tuition_percent,
  CASE WHEN j > 0 THEN cast(floor(once / j * 100 + 0.5) AS BIGINT) END AS one_time_percent, CASE WHEN j > 0 THEN cast(floor(ad / j * 100 + 0.5) AS BIGINT) END AS addons_percent FROM h""")
def cost_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return costs.cost_summary(costs.project(order_records(spark, sf_dir), SCENARIOS))


@_query(f"""{_COSTED},
b AS (SELECT school_name, scenario, years, pct, any_value(app) AS app, any_value(dep) AS dep, any_value(a) AS a, any_value(n) AS n, any_value(first) AS first, any_value(ads) AS ads, sum(tuition) AS t, sum(off) AS o
      FROM f GROUP BY ALL),
i AS (SELECT school_name, scenario, 0 AS place, 'One-Time Mandatory' AS category, '{costs.FEES[0][0]}' AS name, app AS u, app AS t, true AS one_time,
        coalesce((SELECT CASE WHEN x.st = 'F' THEN 'per semester' WHEN x.qty < 10 THEN 'one-time' ELSE 'per year' END FROM (SELECT list_filter(a, lambda x: x.flag = 'A')[1] AS x) WHERE x IS NOT NULL), '{costs.ASK}') AS notes FROM b
  UNION ALL SELECT school_name, scenario, 1, 'One-Time Mandatory', '{costs.FEES[1][0]}', 0, 0, true, '{costs.ASK}' FROM b
  UNION ALL SELECT school_name, scenario, 2, 'One-Time Mandatory', '{costs.FEES[2][0]}', dep, dep, true,
        coalesce((SELECT CASE WHEN x.st = 'F' THEN 'per semester' WHEN x.qty < 10 THEN 'one-time' ELSE 'per year' END FROM (SELECT list_filter(a, lambda x: x.flag = 'R')[1] AS x) WHERE x IS NOT NULL), '{costs.ASK}') FROM b
  UNION ALL SELECT school_name, scenario, 3, 'Annual Tuition', 'Base Tuition (' || years || ' years)', floor(t / years + 0.5), t, false,
        'Line ' || a[first + 1].ln || ' through to Line ' || a[least(first + years - 1, n - 1) + 1].ln FROM b
  UNION ALL SELECT school_name, scenario, 3 + p, 'Selected Campus Add-on', 'Lunch ' || ads[p].st, ads[p].qty * CASE WHEN ads[p].st = 'F' THEN 200 ELSE 100 END,
        CASE WHEN ads[p].st = 'F' THEN ads[p].qty * 200 * years WHEN ads[p].qty < 10 THEN ads[p].qty * 100 ELSE ads[p].qty * 100 * years END, ads[p].st <> 'F' AND ads[p].qty < 10,
        CASE WHEN ads[p].st = 'F' THEN 'per semester' WHEN ads[p].qty < 10 THEN 'one-time' ELSE 'per year' END FROM (SELECT *, unnest(range(1, len(ads) + 1)) AS p FROM b)
  UNION ALL SELECT school_name, scenario, 4 + len(ads), 'Discount', 'Simulated Family / Sibling Discount (' || pct || '%)', floor(o / years + 0.5), -o, false, 'Simulated tuition reduction' FROM b WHERE pct > 0)
SELECT school_name, scenario, cast(place AS INTEGER) AS place, category, name, cast(u AS BIGINT) AS unit_thb, cast(t AS BIGINT) AS total_thb, one_time, notes FROM i""")
def cost_line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return costs.cost_line_items(costs.project(order_records(spark, sf_dir), SCENARIOS))


@_query("""SELECT p_partkey, CASE WHEN contains(lower(p_name), 'widget') OR contains(lower(p_type), 'widget') THEN 2 WHEN contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring') THEN 3
  WHEN contains(lower(p_type), 'econ') THEN 0 ELSE 1 END AS times FROM part""")
def addon_multiplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", costs.yearly_times(F.col("p_name"), F.col("p_type"), ("widget",), ("ring",), ("econ",)).alias("times"))


@_query(f"""WITH {_LINES} SELECT k, list_filter(a, lambda x: x.flag = 'R')[1].price AS returned_price, list_filter(a, lambda x: x.qty > 40)[1].ln AS bulk_line FROM r""")
def first_match_fee(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_lines(spark, sf_dir)
    return rows.select("k", val.first_match(F.col("a"), lambda x: x["flag"] == "R")["price"].alias("returned_price"), val.first_match(F.col("a"), lambda x: x["qty"] > 40)["ln"].alias("bulk_line"))


@_query("""SELECT l_orderkey, min(nullif(l_extendedprice, 0)) AS low, max(nullif(l_extendedprice, 0)) AS high FROM lineitem GROUP BY l_orderkey""")
def array_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_extendedprice")).alias("a"))
    low, high = val.bounds(F.col("a"), "l_extendedprice")
    return rows.select("l_orderkey", low.alias("low"), high.alias("high"))


@_query("""WITH p AS (SELECT l_orderkey, cast(sum(cast(floor(l_extendedprice + 0.5) AS BIGINT)) AS BIGINT) AS total,
  cast(sum(CASE WHEN l_returnflag = 'R' THEN cast(floor(l_extendedprice + 0.5) AS BIGINT) ELSE 0 END) AS BIGINT) AS back FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, total, CASE WHEN total > 0 THEN cast(floor(back / total * 100 + 0.5) AS BIGINT) END AS returned_percent FROM p""")
def share_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = val.half_up(F.col("l_extendedprice"))
    rows = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(price).alias("total"), F.sum(F.when(F.col("l_returnflag") == "R", price).otherwise(0)).alias("back"))
    return rows.select("l_orderkey", "total", val.share_percent(F.col("back"), F.col("total")).alias("returned_percent"))


@_query(f"""WITH {_LINES} SELECT k, len(list_filter(a, lambda x: x.flag = 'R')) > 0 AS any_returned, len(list_filter(a, lambda x: x.st = 'O' AND x.qty > 45)) > 0 AS any_open_bulk FROM r""")
def exists_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_lines(spark, sf_dir).select("k", F.exists("a", lambda x: x["flag"] == "R").alias("any_returned"), F.exists("a", lambda x: (x["st"] == "O") & (x["qty"] > 45)).alias("any_open_bulk"))


@_query("""WITH o AS (SELECT c_custkey, list({'key': o_orderkey, 'price': cast(floor(o_totalprice + 0.5) AS BIGINT)} ORDER BY o_orderkey) FILTER (WHERE o_orderkey IS NOT NULL) AS a
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey),
b AS (SELECT c_custkey, cast(floor(c_acctbal + 0.5) AS BIGINT) AS bal FROM customer),
lo AS (SELECT *, CASE WHEN bal = 0 OR bal > 5000 THEN 520000 ELSE bal END AS low, CASE WHEN bal <= 5000 THEN 750000 ELSE bal END AS high FROM b),
m AS (SELECT *, cast(floor((low + high) / 2 + 0.5) AS BIGINT) AS mid FROM lo),
t AS (SELECT c_custkey, i AS place, 'Order ' || a[i].key AS grade_level, a[i].price AS annual_thb, cast(NULL AS BIGINT) AS semester_thb FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM o WHERE len(a) > 0)
  UNION ALL SELECT c_custkey, i, ['Early Years / Kindergarten', 'Primary (Years 1–6 / Grades 1–5)', 'Secondary & High School'][i], [low, mid, high][i], cast(floor([low, mid, high][i] / 2 + 0.5) AS BIGINT)
  FROM (SELECT m.*, unnest([1, 2, 3]) AS i FROM m JOIN o USING (c_custkey) WHERE coalesce(len(a), 0) = 0))
SELECT c_custkey, cast(place AS INTEGER) AS place, grade_level, annual_thb, semester_thb FROM t""")
def fallback_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    bal, price = val.half_up(F.col("c_acctbal")), val.half_up(F.col("o_totalprice"))
    customers = _table(spark, sf_dir, "customer").select("c_custkey", F.when(bal <= 5000, bal).alias("low"), F.when(bal > 5000, bal).alias("high"))
    none = customers.join(orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    made = none.select("c_custkey", F.posexplode(costs.tiers(F.lit(None).cast(f"array<{costs.TIER}>"), F.col("low"), F.col("high"))).alias("p", "t"))
    made = made.select("c_custkey", (F.col("p") + 1).alias("place"), "t.grade_level", "t.annual_thb", "t.semester_thb")
    # numbered rather than gathered: a customer may have any number of orders
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    given = orders.select(F.col("o_custkey").alias("c_custkey"), place.alias("place"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("grade_level"), price.alias("annual_thb"), F.lit(None).cast("bigint").alias("semester_thb"))
    return given.join(customers.select("c_custkey"), "c_custkey", "left_semi").unionByName(made)


@_query("""SELECT o_orderkey, CASE WHEN o_totalprice < 1000 THEN NULL WHEN o_orderstatus = 'F' AND contains(lower(o_orderpriority), 'urgent') THEN greatest(0, cast(floor(o_totalprice + 0.5) AS BIGINT) - 100000)
  ELSE cast(floor(o_totalprice + 0.5) AS BIGINT) END AS fee FROM orders""")
def discount_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    fee = F.when(F.col("o_totalprice") >= 1000, val.half_up(F.col("o_totalprice")))
    return _table(spark, sf_dir, "orders").select("o_orderkey", costs.deducted(fee, F.col("o_orderpriority"), F.col("o_orderstatus"), [("urgent", 100000)], "F").alias("fee"))


# Validation and ingest

_RECORDS = """b AS (SELECT c_custkey AS k, cast(floor(c_acctbal + 0.5) AS BIGINT) AS bal, CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN ' Unclear ' ELSE c_mktsegment END AS cur,
  c_custkey % 3 <> 0 AS found, c_custkey % 11 AS kind, CASE c_custkey % 13 WHEN 0 THEN 'abc' WHEN 1 THEN '1.5' WHEN 2 THEN NULL ELSE '0.9' END AS conf FROM customer),
e AS (SELECT k, cur, list_filter(list_concat([CASE WHEN coalesce(cur, '') = '' THEN 'Curriculum information is missing.' WHEN lower(trim(cur)) = 'unclear' THEN 'Curriculum type is unclear or unknown (''' || cur || ''').' END],
  CASE WHEN NOT found THEN [] WHEN kind = 0 THEN ['Tuition was marked as found, but the grade breakdown table is empty.', CASE WHEN bal < 0 THEN 'Minimum tuition cannot be negative: ' || bal END]
    ELSE [CASE WHEN kind = 1 THEN 'Grade breakdown item at index 0 is missing ''grade_level''.' END, CASE WHEN bal < 0 THEN 'Annual tuition for ''' || (CASE WHEN kind = 1 THEN 'None' ELSE 'G' || kind END) || ''' cannot be negative: ' || bal END,
          CASE WHEN bal < 0 THEN 'Minimum tuition cannot be negative: ' || bal END] END,
  [CASE WHEN kind = 2 THEN 'Hidden cost item at index 0 is missing a name.' END, CASE WHEN bal - 500 < 0 THEN 'Hidden cost amount for ''' || (CASE WHEN kind = 2 THEN 'None' ELSE 'Bus' END) || ''' cannot be negative: ' || (bal - 500) END],
  [CASE WHEN conf = 'abc' THEN 'Confidence score must be a number: abc' WHEN conf = '1.5' THEN 'Confidence score must be between 0.0 and 1.0: 1.5' END]), lambda x: x IS NOT NULL) AS errors FROM b)"""


def customer_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as records with faults."""
    k, bal = F.col("c_custkey"), val.half_up(F.col("c_acctbal"))
    kind, none = k % 11, lambda t: F.lit(None).cast(t)
    grade = F.struct(F.when(kind != 1, F.concat(F.lit("G"), kind.cast("string"))).alias("grade_level"), bal.alias("annual_thb"), none("bigint").alias("semester_thb"), none("string").alias("notes"))
    cost = F.struct(F.when(kind != 2, F.lit("Bus")).alias("name"), (bal - 500).alias("amount_thb"), none("string").alias("notes"))
    return _table(spark, sf_dir, "customer").select(
        k.alias("k"), F.when(k % 7 == 1, " Unclear ").when(k % 7 != 0, F.col("c_mktsegment")).alias("curriculum"), (k % 3 != 0).alias("tuition_found"),
        F.when(kind != 0, F.array(grade)).alias("tuition_by_grade"), bal.alias("tuition_min_thb"), none("bigint").alias("tuition_max_thb"), F.array(cost).alias("hidden_costs"),
        F.when(k % 13 == 0, "abc").when(k % 13 == 1, "1.5").when(k % 13 != 2, "0.9").alias("confidence"),
    )


@_query(f"WITH {_RECORDS} SELECT k, array_to_string(errors, ' | ') AS errors, CASE WHEN len(errors) = 0 THEN 'success' ELSE 'failed' END AS validation FROM e")
def validate_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.validated(customer_records(spark, sf_dir)).select("k", F.array_join("errors", " | ").alias("errors"), "validation")


@_query("""WITH b AS (SELECT c_custkey AS k, cast(floor(c_acctbal) AS BIGINT) AS bal FROM customer),
e AS (SELECT k, CASE WHEN k % 8 = 7 THEN ['Record is not a JSON object.'] ELSE list_filter([CASE WHEN k % 9 = 0 THEN '''tuition_by_grade'' must be a list.' END, CASE WHEN k % 6 = 1 THEN '''tuition_min_thb'' must be a number.' END,
  CASE WHEN k % 5 = 0 THEN 'Curriculum information is missing.' END,
  CASE WHEN k % 9 = 0 THEN 'Tuition was marked as found, but the grade breakdown table is empty.' WHEN bal < 0 THEN 'Annual tuition for ''G1'' cannot be negative: ' || bal END,
  CASE WHEN k % 8 = 2 THEN '''safety_and_security'' must be a dictionary/object.' END, CASE WHEN k % 8 IN (4, 6) THEN '''safety_and_security.highlights'' must be a list.' END,
  CASE WHEN k % 8 IN (5, 6) THEN '''safety_and_security.policy_summary'' must be a string.' END], lambda x: x IS NOT NULL) END AS errors FROM b)
SELECT k, array_to_string(errors, ' | ') AS errors, CASE WHEN len(errors) = 0 THEN 'success' ELSE 'failed' END AS validation FROM e""")
def validate_untyped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as JSON texts with faults of kind, of form and of value."""
    k, bal = F.col("c_custkey"), F.floor("c_acctbal").cast("string")
    safety = F.element_at(F.array(*(F.lit(x) for x in (
        "", ', "safety_and_security": null', ', "safety_and_security": "yes"', ', "safety_and_security": {"highlights": ["a"], "policy_summary": "ok"}', ', "safety_and_security": {"highlights": "a"}',
        ', "safety_and_security": {"policy_summary": 5}', ', "safety_and_security": {"highlights": null, "policy_summary": null}', ", cut off",
    ))), (k % 8 + 1).cast("int"))
    grades = F.when(k % 9 == 0, F.lit('"none"')).otherwise(F.concat(F.lit('[{"grade_level": "G1", "annual_thb": '), bal, F.lit("}]")))
    curriculum, low = F.when(k % 5 == 0, F.lit('""')).otherwise(F.lit('"IB"')), F.when(k % 6 == 1, F.lit('"low"')).otherwise(F.lit("1.5"))
    text = F.concat(F.lit('{"curriculum": '), curriculum, F.lit(', "tuition_found": true, "tuition_min_thb": '), low, F.lit(', "tuition_by_grade": '), grades, safety, F.lit("}"))
    rows = _table(spark, sf_dir, "customer").select(k.alias("k"), text.alias("text"))
    return validate.validated_json(rows, "text").select("k", F.array_join("errors", " | ").alias("errors"), "validation")


@_query(f"""WITH {_RECORDS}, good AS (SELECT CASE WHEN k % 2 = 0 THEN lower(c_name) ELSE 'New ' || c_name END AS name, k, cur FROM e JOIN customer ON c_custkey = k WHERE len(errors) = 0),
last AS (SELECT name, arg_max(k, k) AS k, arg_max(cur, k) AS cur FROM good GROUP BY name)
SELECT c_name AS name, c_custkey AS k, c_mktsegment AS curriculum FROM customer WHERE lower(c_name) NOT IN (SELECT lower(name) FROM last) UNION ALL SELECT name, k, cur FROM last""")
def ingest_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("curriculum"))
    good, _ = split(customer_records(spark, sf_dir))
    named = good.join(base.select("k", "name"), "k").withColumn("name", F.when(F.col("k") % 2 == 0, F.lower("name")).otherwise(F.concat(F.lit("New "), "name")))
    return upsert.upsert(base, named.select("name", "k", "curriculum", F.col("k").alias("seq")), "name", "seq")


# Files, versions and logs: written, read back, and compared with what went in


def _new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


@_query(f"""WITH {_LINES} SELECT 'Order ' || k AS school_name, len(a) AS n_tiers, list_sum(list_transform(a, lambda x: x.price)) AS annual_thb, len(list_filter(a, lambda x: x.flag = 'A')) AS n_application,
  list_sum(list_transform(a, lambda x: x.qty * 100)) AS costs_thb FROM r""")
def record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _new_folder(spark, "records")
    records.write_records(order_records(spark, sf_dir), path)
    read = records.read_records(spark, path)
    total = lambda items, field: F.aggregate(items, F.lit(0).cast("bigint"), lambda s, x: s + x[field])
    of_kind = F.size(F.filter("hidden_costs", lambda c: c["name"] == "Application fee"))
    return read.select("school_name", F.size("tuition_by_grade").cast("bigint").alias("n_tiers"), total(F.col("tuition_by_grade"), "annual_thb").alias("annual_thb"), of_kind.cast("bigint").alias("n_application"), total(F.col("hidden_costs"), "amount_thb").alias("costs_thb"))


@_query("SELECT 'empty' AS kind, s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT 'missing', s_suppkey, s_name FROM supplier UNION ALL SELECT 'file', s_suppkey, upper(s_name) FROM supplier")
def seed_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    empty, full = _new_folder(spark, "records"), _new_folder(spark, "records")
    records.write_records(seed.limit(0), empty)
    records.write_records(seed.withColumn("name", F.upper("name")), full)
    read = {"empty": empty, "missing": _new_folder(spark, "none"), "file": full}
    parts = [records.records_or_seed(spark, path, seed).select(F.lit(kind).alias("kind"), "id", "name") for kind, path in read.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@_query("""SELECT 'seed' AS kind, s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT 'sound files', s_suppkey, upper(s_name) FROM supplier UNION ALL SELECT 'faulty', count(*), '[{"id": 1, "na' FROM (SELECT 1 UNION ALL SELECT 2)""")
def corrupt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of sound files and two that are cut off: what is read of it in either way, and how many files are faulty."""
    seed = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    folder = _new_folder(spark, "records")
    records.write_records(seed.withColumn("name", F.upper("name")), f"{folder}/part=sound")
    cut = spark.createDataFrame([('[{"id": 1, "na',)], "value string").coalesce(1)
    for part in ("a", "z"):  # before and after the sound ones
        cut.write.text(f"{folder}/part={part}")
    path = f"{folder}/part=*"
    seeded = records.records_or_seed(spark, path, seed).select(F.lit("seed").alias("kind"), "id", "name")
    sound = records.records_or_seed(spark, path, seed, keep_sound=True).select(F.lit("sound files").alias("kind"), "id", "name")
    faulty = records.checked_records(spark, path, "id bigint, name string")[1].groupBy(F.trim(F.regexp_replace("start", "\\n", "")).alias("name")).agg(F.count("*").alias("id")).select(F.lit("faulty").alias("kind"), "id", "name")
    return seeded.unionByName(sound).unionByName(faulty)


@_query("""WITH c AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS amount, c_nationkey % 2 = 0 AS flag FROM customer)
SELECT 'school' AS kind, id, name, cast(floor(amount) AS BIGINT) AS whole, amount AS real, 'Bangkok' AS extra FROM c UNION ALL SELECT 'detail', id, name, 2, amount, 'fee ' || id FROM c
UNION ALL SELECT 'post', id, name, cast(floor(amount) AS BIGINT), NULL, CASE WHEN flag THEN 'liked' ELSE 'not' END FROM c UNION ALL SELECT 'coordinate', id, name, 0, amount, NULL FROM c""")
def seed_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as schools, details, posts and coordinates, and read back by those schemas."""
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").cast("double").alias("amount"), (F.col("c_nationkey") % 2 == 0).alias("flag"))
    none, text = (lambda kind: F.lit(None).cast(kind)), F.col("id").cast("string")
    fees = F.array(F.struct(F.concat(F.lit("fee "), text).alias("label"), text.alias("amount")), F.struct(F.lit("x").alias("label"), text.alias("amount")))
    review = F.struct(F.lit("a").alias("author"), F.col("amount").alias("rating"))
    comment = F.struct(F.col("id").alias("id"), F.col("name").alias("author"), F.col("flag").alias("liked"))
    made = {
        "school": c.select("id", "name", F.lit("Bangkok").alias("location"), F.floor("amount").alias("tuitionStart"), F.col("amount").alias("rating")),
        "detail": c.select("id", F.col("name").alias("about"), fees.alias("fees"), F.array(review).alias("reviews")),
        "post": c.select("id", F.col("name").alias("author"), F.floor("amount").alias("likes"), F.col("flag").alias("liked"), F.array(comment).alias("comments")),
        "coordinate": c.select("id", "name", F.col("amount").alias("lat")),
    }
    wanted = {
        "school": ["id", "name", F.col("tuitionStart").alias("whole"), F.col("rating").alias("real"), F.col("location").alias("extra")],
        "detail": ["id", F.col("about").alias("name"), F.size("fees").cast("bigint").alias("whole"), F.col("reviews")[0]["rating"].alias("real"), F.col("fees")[0]["label"].alias("extra")],
        "post": ["id", F.col("comments")[0]["author"].alias("name"), F.col("likes").alias("whole"), none("double").alias("real"), F.when(F.col("liked") & F.col("comments")[0]["liked"], "liked").otherwise("not").alias("extra")],
        "coordinate": ["id", "name", F.lit(0).cast("bigint").alias("whole"), F.col("lat").alias("real"), none("string").alias("extra")],
    }
    out = []
    for kind, ddl in {"school": schema.SCHOOL, "detail": schema.DETAIL, "post": schema.POST, "coordinate": schema.COORDINATE}.items():
        path = _new_folder(spark, kind)
        records.write_records(made[kind], path)
        out.append(records.read_records(spark, path, ddl).select(F.lit(kind).alias("kind"), *wanted[kind]))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@_query("""SELECT cast(user_id AS VARCHAR) AS school_name, event_type AS step, CASE WHEN event_id % 2 = 0 THEN 'ok' ELSE 'failed' END AS status, count(*) AS n, max(value) AS confidence, cast(count(*) AS BIGINT) AS n_stamped
FROM events GROUP BY ALL""")
def step_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, none = _new_folder(spark, "log"), F.lit(None).cast("string")
    events = _table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("school_name"), F.col("event_type").alias("step"), none.alias("action_taken"), none.alias("url_visited"), none.alias("decision_reasoning"),
        F.col("value").alias("confidence"), F.when(F.col("event_id") % 2 == 0, "ok").otherwise("failed").alias("status"),
    )
    for status in ("ok", "failed"):
        records.append_log(events.where(F.col("status") == status), path)
    log = spark.read.parquet(path)
    return log.groupBy("school_name", "step", "status").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"), F.count("at").alias("n_stamped"))


@_query("SELECT 'first' AS state, s_suppkey, s_acctbal FROM supplier UNION ALL SELECT 'second', s_suppkey, s_acctbal + 1 FROM supplier UNION ALL SELECT 'rolled back', s_suppkey, s_acctbal FROM supplier")
def version_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    table = VersionedTable(spark, _new_folder(spark, "versions"))
    first = table.commit(rows)
    state_of = lambda name: table.read().select(F.lit(name).alias("state"), "s_suppkey", "s_acctbal")
    out = state_of("first")
    table.commit(rows.withColumn("s_acctbal", F.col("s_acctbal") + 1))
    out = out.unionByName(state_of("second"))
    table.rollback(first)
    return out.unionByName(state_of("rolled back"))


@_query(f"""WITH {_RECORDS} SELECT 'Customer ' || k AS school_name, 'validate' AS step, CASE WHEN len(errors) = 0 THEN 'ok' ELSE 'failed' END AS status, CASE WHEN len(errors) > 0 THEN array_to_string(errors, ' ') END AS decision_reasoning FROM e
UNION ALL SELECT 'Customer ' || k, 'save', 'ok', NULL FROM e WHERE len(errors) = 0""")
def ingest_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = customer_records(spark, sf_dir).select(F.concat(F.lit("Customer "), F.col("k").cast("string")).alias("school_name"), F.col("k").alias("seq"), "*").drop("k")
    folder = _new_folder(spark, "ingest")
    ingest(VersionedTable(spark, f"{folder}/table"), f"{folder}/batches", named, "school_name", "seq", f"{folder}/log")
    return spark.read.parquet(f"{folder}/log").select("school_name", "step", "status", "decision_reasoning")


@_query("""WITH b AS (SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal FROM customer),
d AS (SELECT CASE WHEN k % 50 = 0 THEN upper(name) ELSE name END AS name, k, CASE WHEN k % 50 = 0 THEN bal + 2 ELSE bal END AS bal FROM b WHERE k % 33 <> 0 UNION ALL SELECT 'New ' || name, k, bal FROM b WHERE k % 40 = 1),
c AS (SELECT name, k, bal FROM d WHERE starts_with(name, 'New ') OR NOT (k % 50 = 0 OR k % 99 = 0) UNION ALL SELECT lower(name), k, 0 FROM b WHERE k % 50 = 0 OR k % 99 = 0)
SELECT 'deltas' AS state, name, k, bal FROM d UNION ALL SELECT 'compacted', name, k, bal FROM d UNION ALL SELECT 'delta on top', name, k, bal FROM c UNION ALL SELECT 'rolled back', name, k, bal FROM b""")
def merge_on_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"))
    table = MergeTable(spark, _new_folder(spark, "merged"), "name", base.schema, buckets=16)
    state_of = lambda name: table.read().select(F.lit(name).alias("state"), "name", "k", "bal")
    first = table.commit(base)
    some = base.where("k % 50 = 0").withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2))))
    table.upsert(some.withColumns({"name": F.upper("name"), "bal": F.col("bal") + F.col("seq")}), "seq")
    table.upsert(base.where("k % 40 = 1").withColumns({"name": F.concat(F.lit("New "), "name"), "seq": F.lit(1)}), "seq")
    table.remove(base.where("k % 33 = 0"))
    out = state_of("deltas")
    table.compact()
    out = out.unionByName(state_of("compacted"))
    table.upsert(base.where("k % 50 = 0 or k % 99 = 0").withColumns({"name": F.lower("name"), "bal": F.lit(0.0), "seq": F.lit(1)}), "seq")
    out = out.unionByName(state_of("delta on top"))
    table.rollback(first)
    return out.unionByName(state_of("rolled back"))


@_query(f"""WITH {_RECORDS}, s AS (SELECT k, len(errors) > 0 AS bad, cur, k % 2 AS half FROM e)
SELECT 'table' AS what, cast(half AS VARCHAR) AS batch, count(*) AS n, max(k) AS last FROM s WHERE NOT bad GROUP BY half
UNION ALL SELECT 'quarantine', cast(half AS VARCHAR), count(*), max(k) FROM s WHERE bad GROUP BY half
UNION ALL SELECT 'log', cast(half AS VARCHAR), cast(sum(CASE WHEN bad THEN 1 ELSE 2 END) AS BIGINT), max(k) FROM s GROUP BY half""")
def ingest_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches, each given twice, into a table that merges on read: what the table, the quarantine and the log hold of each."""
    named = customer_records(spark, sf_dir).select(F.concat(F.lit("Customer "), F.col("k").cast("string")).alias("school_name"), F.col("k").alias("seq"), "*")
    folder = _new_folder(spark, "ingest")
    table = MergeTable(spark, f"{folder}/table", "school_name", named.drop("seq").schema, buckets=16)
    for half in ("0", "1", "0", "1"):
        ingest(table, f"{folder}/batches", named.where(F.col("k") % 2 == int(half)), "school_name", "seq", f"{folder}/log", batch=half)
    recover(table, f"{folder}/batches", "school_name", f"{folder}/log")
    half = (F.col("k") % 2).cast("string").alias("batch")
    saved = table.read().select(F.lit("table").alias("what"), half, "k")
    failed = quarantined(spark, f"{folder}/batches").select(F.lit("quarantine").alias("what"), F.col("batch").cast("string").alias("batch"), "k")
    log = spark.read.parquet(f"{folder}/log").select(F.lit("log").alias("what"), F.col("batch").cast("string").alias("batch"), F.substring_index("school_name", " ", -1).cast("bigint").alias("k"))
    return saved.unionByName(failed).unionByName(log).groupBy("what", "batch").agg(F.count("*").alias("n"), F.max("k").alias("last"))


# Pages and texts

_PLAIN_ANCHOR = r'<a\s[^>]*?href="([^"]*)"[^>]*>([^<]*)</a>'  # all anchors of the test tables are of this form
_ANCHORS = rf"""a AS (SELECT page_id, url, regexp_extract_all(html, '{_PLAIN_ANCHOR}', 1) AS hs, regexp_extract_all(html, '{_PLAIN_ANCHOR}', 2) AS ts FROM pages),
b AS (SELECT page_id, url, i - 1 AS pos, hs[i] AS h, ts[i] AS text FROM (SELECT *, unnest(range(1, len(hs) + 1)) AS i FROM a)),
k AS (SELECT page_id, pos, text, CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN h WHEN starts_with(h, '//') THEN 'https:' || h WHEN starts_with(h, '/') THEN regexp_extract(url, '^(https?://[^/]+)', 1) || h
  ELSE rtrim(regexp_extract(url, '^(https?://[^/]+(?:/[^?#]*/)?)', 1), '/') || '/' || h END AS href FROM b)"""


@_query(rf"""WITH {_ANCHORS}, c AS (SELECT page_id, pos, href, substr(trim(text), 1, 80) AS text, unnest(list_filter([CASE WHEN contains(lower(text || ' ' || href), 'tion') OR contains(lower(text || ' ' || href), 'de') THEN 'fee' END,
  CASE WHEN contains(lower(text || ' ' || href), 'an') THEN 'safety' END], lambda x: x IS NOT NULL)) AS class FROM k WHERE starts_with(href, 'http')),
f AS (SELECT page_id, class, href, min(pos) AS pos, arg_min(text, pos) AS text FROM c GROUP BY page_id, class, href),
g AS (SELECT *, row_number() OVER (PARTITION BY page_id, class ORDER BY pos) AS place FROM f)
SELECT page_id, class, cast(place AS INTEGER) AS place, href, text FROM g WHERE place <= 12""")
def link_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.link_candidates(_table(spark, sf_dir, "pages"), {"fee": ("tion", "de"), "safety": ("an",)})


_STRIP = [*(rf"(?is)<{t}\b[^>]*>.*?</{t}>" for t in texts.DROPPED), r"(?s)<!--.*?-->", "<[^>]*>"]  # the test tables hold no hidden element
_CLEAN = "html"
for _p in _STRIP:
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', chr(10), 'g')"
for _a, _b in texts.ENTITIES:
    _CLEAN = "regexp_replace({}, '{}?', '{}', 'g')".format(_CLEAN, _a, _b.replace("'", "''"))  # also read without the semicolon


@_query(rf"""SELECT page_id, substr(regexp_replace(regexp_replace({_CLEAN}, '\n\n+', chr(10), 'g'), '{texts.EDGES}', '', 'g'), 1, 9000) AS text FROM pages""")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", texts.clean_text(F.col("html")).alias("text"))


@_query(rf"""WITH {_ANCHORS}, good AS (SELECT page_id, 0 AS src, pos, href, CASE WHEN contains(lower(href), 'de') OR contains(lower(text), 'de') THEN 2 ELSE 0 END AS score FROM k WHERE contains(lower(href), '/t')
  UNION ALL SELECT page_id, 2, i, h, CASE WHEN contains(lower(h), 'de') THEN 1 ELSE 0 END FROM (SELECT page_id, hs[i] AS h, i FROM (SELECT page_id, hs, unnest(range(1, len(hs) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?i)https?://[^\s''"<>]+/t') AS hs FROM pages)))
  UNION ALL SELECT page_id, 3, 0, url, 4 FROM pages WHERE page_id % 10 = 0),
best AS (SELECT page_id, href, max(score) AS score, min(src * 1000000 + pos) AS sight FROM good GROUP BY page_id, href),
g AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, sight) AS place FROM best)
SELECT page_id, cast(place AS INTEGER) AS place, href, score FROM g WHERE place <= 2""")
def url_scoring_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").withColumn("seen", F.when(F.col("page_id") % 10 == 0, F.array("url")))
    return links.scored_documents(pages, "/t", ("de",), "seen")


@_query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://policy.example/' || page_id WHEN len(h) > 0 THEN h[1] ELSE url END AS policy_url
FROM (SELECT *, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages)""")
def coalesce_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://policy.example/"), F.col("page_id").cast("string"))).otherwise("")
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return _table(spark, sf_dir, "pages").select("page_id", fees.policy_url(known, found, F.col("url")).alias("policy_url"))


@_query("""SELECT conv_id, string_agg('--- ' || coalesce(role, '') || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY turn, '--- ' || coalesce(role, '') || ' ---' || chr(10) || text) AS sections
FROM conversations WHERE text <> '' GROUP BY conv_id""")
def section_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.joined_turns(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


@_query(r"""WITH p AS (SELECT conv_id AS k, turn + 1 AS p, coalesce(text, '') AS t, contains(lower(coalesce(text, '')), 'ter') AS w FROM conversations),
h AS (SELECT k, coalesce(string_agg(t, chr(10) ORDER BY p, t) FILTER (WHERE p <= 5 AND regexp_matches(t, '[^\s]')), '') AS plain FROM p GROUP BY k),
f AS (SELECT k, string_agg('--- หน้าที่ ' || p || ' ---' || chr(10) || t, chr(10) || chr(10) ORDER BY p, t) AS marked
  FROM (SELECT *, dense_rank() OVER (PARTITION BY k ORDER BY p) AS place FROM p WHERE w) WHERE place <= 4 GROUP BY k),
c AS (SELECT k, regexp_replace(plain, '^\s+|\s+$', '', 'g') AS plain, marked FROM h LEFT JOIN f USING (k))
SELECT k AS conv_id, substr(CASE WHEN length(plain) >= 200 THEN plain ELSE coalesce(marked, plain) END, 1, 8000) AS text FROM c""")
def document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).alias("page"), "text")
    return texts.document_text(pages, "conv_id", "page", "text", ("ter",), head_text=texts.PAGE_HEAD)


@_query(r"""WITH l AS (SELECT page_id, url, html, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages),
d AS (SELECT page_id, url, array_to_string(list_transform(list_filter(h, lambda x: x <> '#'), lambda x: chr(10) || chr(10) || '--- Fee PDF content from doc ---' || chr(10) || x), '') AS docs FROM l)
SELECT page_id, '=== TUITION & FEE PAGE (' || url || ') ===' || chr(10) || 'page ' || page_id || docs
  || CASE WHEN page_id % 2 = 0 THEN chr(10) || chr(10) || '=== CAMPUS SAFETY & SAFEGUARDING POLICY PAGE (safe' || page_id || ') ===' || chr(10) ELSE '' END AS text FROM d""")
def collected_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    documents = F.transform(found, lambda x: F.struct(F.lit("doc").alias("url"), F.when(x != "#", x).alias("text")))
    number, none = F.col("page_id").cast("string"), F.lit(None).cast("array<struct<url:string,text:string>>")
    safe = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("safe"), number))
    return _table(spark, sf_dir, "pages").select("page_id", texts.collected_text(F.col("url"), F.concat(F.lit("page "), number), documents, safe, F.lit(None).cast("string"), none).alias("text"))


@_query("SELECT doc_id, CASE WHEN length(text) < 220 THEN text ELSE substr(text, 1, 220) || '…' END AS preview FROM documents")
def truncate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", show.shortened(F.col("text")).alias("preview"))


@_query("""SELECT conv_id, turn, role, cast(place AS INTEGER) AS place, greatest(n - 2, 0) AS more FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place,
  count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE place <= 2""")
def top2_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = texts.first_items(_table(spark, sf_dir, "conversations"), "conv_id", ["turn", "role", "text"])
    return rows.select("conv_id", "turn", "role", "place", "more")


# State


@_query("SELECT user_id, event_type, count(*) AS n_toggles FROM events GROUP BY user_id, event_type HAVING count(*) % 2 = 1")
def toggle_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.toggled_on(_table(spark, sf_dir, "events"), ["user_id", "event_type"])


@_query("""WITH o AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS a FROM events GROUP BY user_id)
SELECT user_id, array_to_string(list_reduce(list_prepend(cast([] AS VARCHAR[]), list_transform(a, lambda x: [x])),
  lambda s, e: CASE WHEN list_contains(s, e[1]) THEN list_filter(s, lambda v: v <> e[1]) WHEN len(s) < 3 THEN list_append(s, e[1]) ELSE s END), ',') AS items FROM o""")
def bounded_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = state.bounded_toggle(_table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"])
    return folded.select("user_id", F.array_join("items", ",").alias("items"))


@_query("""WITH o AS (SELECT list(event_type ORDER BY ts, event_id) AS a FROM events)
SELECT 'all' AS user, array_to_string(list_reduce(list_prepend(cast([] AS VARCHAR[]), list_transform(a, lambda x: [x])),
  lambda s, e: CASE WHEN list_contains(s, e[1]) THEN list_filter(s, lambda v: v <> e[1]) WHEN len(s) < 3 THEN list_append(s, e[1]) ELSE s END), ',') AS items FROM o""")
def bounded_toggle_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One user holds all toggles, in ranges of time."""
    events = _table(spark, sf_dir, "events").select(F.lit("all").alias("user"), "event_type", "ts", "event_id")
    return state.bounded_toggle(events, "user", "event_type", ["ts", "event_id"]).select("user", F.array_join("items", ",").alias("items"))


@_query(f"""WITH {_LINES}, e AS (SELECT event_id % (SELECT count(*) FROM customer) AS k, CASE WHEN event_id % 3 > 0 THEN event_id % 5 END AS c FROM events),
o AS (SELECT k, c FROM e GROUP BY k, c HAVING count(*) % 2 = 1),
p AS (SELECT k, len(a) % 7 AS likes, k % 2 = 0 AS liked, a FROM r),
x AS (SELECT p.k, likes, liked <> (EXISTS (SELECT 1 FROM o WHERE o.k = p.k AND o.c IS NULL)) AS liked, coalesce((SELECT list(c) FROM o WHERE o.k = p.k AND c IS NOT NULL), []) AS cs, a FROM p),
y AS (SELECT k, likes + CASE WHEN liked THEN 1 ELSE 0 END AS likes, liked, cs, unnest(a) AS l FROM x)
SELECT k AS id, cast(likes AS BIGINT) AS likes, liked, cast(l.ln AS BIGINT) AS comment, cast(l.qty + CASE WHEN list_contains(cs, l.ln) THEN 1 ELSE 0 END AS BIGINT) AS comment_likes, list_contains(cs, l.ln) AS comment_liked FROM y""")
def liked_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _table(spark, sf_dir, "customer").count()
    toggles = _table(spark, sf_dir, "events").select((F.col("event_id") % n).alias("id"), F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 5).alias("comment_id"))
    line = lambda x: F.struct(x["ln"].cast("bigint").alias("id"), x["qty"].alias("likes"), F.lit(None).cast("boolean").alias("liked"))
    posts = order_lines(spark, sf_dir).select(F.col("k").alias("id"), (F.size("a") % 7).cast("bigint").alias("likes"), (F.col("k") % 2 == 0).alias("liked"), F.transform("a", line).alias("comments"))
    shown = state.liked_posts(posts, toggles).select("id", "likes", "liked", F.explode("comments").alias("c"))
    return shown.select("id", "likes", "liked", F.col("c.id").alias("comment"), F.col("c.likes").alias("comment_likes"), F.col("c.liked").alias("comment_liked"))


# Display texts


@_query("""WITH c AS (SELECT o_orderkey, o_totalprice, CASE o_orderkey % 7 WHEN 0 THEN 'THB' WHEN 1 THEN 'USD' WHEN 2 THEN 'GBP' WHEN 3 THEN 'EUR' WHEN 4 THEN 'SGD' WHEN 5 THEN 'CNY' ELSE 'XXX' END AS code FROM orders),
r AS (SELECT *, CASE code WHEN 'USD' THEN 0.029::DOUBLE WHEN 'GBP' THEN 0.023::DOUBLE WHEN 'EUR' THEN 0.027::DOUBLE WHEN 'SGD' THEN 0.038::DOUBLE WHEN 'CNY' THEN 0.21::DOUBLE ELSE 1::DOUBLE END AS rate,
  CASE code WHEN 'USD' THEN '$' WHEN 'GBP' THEN '£' WHEN 'EUR' THEN '€' WHEN 'SGD' THEN 'S$' WHEN 'CNY' THEN '¥' ELSE '฿' END AS sign FROM c)
SELECT o_orderkey, sign || format('{:,}', cast(floor(o_totalprice * rate + 0.5) AS BIGINT)) AS label FROM r""")
def currency_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.get(F.array(*map(F.lit, ("THB", "USD", "GBP", "EUR", "SGD", "CNY", "XXX"))), (F.col("o_orderkey") % 7).cast("int"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", show.currency(F.col("o_totalprice"), code).alias("label"))


_TENTH = "(cast(cast(({0}) * 4503599627370496.0::DOUBLE AS BIGINT) AS HUGEINT) * 20 + 4503599627370496) // 9007199254740992"


@_query(f"""WITH a AS (SELECT c_custkey, cast(abs(c_acctbal) * 500 AS DOUBLE) AS amount, abs(c_acctbal) / 1000 AS km, abs(c_acctbal) / 2000 AS rating FROM customer),
t AS (SELECT *, {_TENTH.format("amount / 1000000")} AS m, {_TENTH.format("km")} AS d FROM a)
SELECT c_custkey, CASE WHEN amount >= 1000000 THEN '฿' || (m // 10) || '.' || (m % 10) || 'M' ELSE '฿' || cast(floor(amount / 1000 + 0.5) AS BIGINT) || 'K' END AS tuition,
  CASE WHEN km < 1 THEN cast(floor(km * 1000 + 0.5) AS BIGINT) || ' m' ELSE (d // 10) || '.' || (d % 10) || ' km' END AS distance, cast(least(5, floor(rating + 0.5)) AS INTEGER) AS stars FROM t""")
def compact_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.abs("c_acctbal")
    return _table(spark, sf_dir, "customer").select("c_custkey", show.compact_amount(x * 500).alias("tuition"), show.distance_label(x / 1000).alias("distance"), show.stars(x / 2000).alias("stars"))


@_query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%b %-d, %Y') WHEN 1 THEN strftime(o_orderdate, '%b %-d, %Y') WHEN 2 THEN 'September 2026' ELSE 'Term ' || o_orderstatus END AS label FROM orders""")
def last_updated_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, date = F.col("o_orderkey") % 4, F.col("o_orderdate")
    text = F.when(kind == 0, F.date_format(date, "yyyy-MM-dd")).when(kind == 1, F.date_format(date, "yyyy/MM/dd")).when(kind == 2, "").otherwise(F.concat(F.lit("Term "), "o_orderstatus"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", show.updated_label(text).alias("label"))


@_query("""WITH p AS (SELECT c_custkey, radians(13 + (c_custkey % 1000) / 1000) AS la, radians(100 + (c_custkey % 777) / 777) AS ln, radians(13.7306) AS la0, radians(100.5688) AS ln0 FROM customer),
h AS (SELECT c_custkey, pow(sin((la - la0) / 2), 2) + cos(la0) * cos(la) * pow(sin((ln - ln0) / 2), 2) AS a FROM p)
SELECT c_custkey, round(2 * 6371 * atan2(sqrt(a), sqrt(1 - a)), 3) AS km, 2 * 6371 * atan2(sqrt(a), sqrt(1 - a)) <= 10 AS near FROM h""")
def haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    km = show.kilometres(13 + (F.col("c_custkey") % 1000) / 1000, 100 + (F.col("c_custkey") % 777) / 777, 13.7306, 100.5688)
    return _table(spark, sf_dir, "customer").select("c_custkey", F.round(km, 3).alias("km"), (km <= 10).alias("near"))


@_query(f"""WITH {_LINES}, x AS (SELECT k, list_concat(list_transform(a, lambda x: {{'l': 'Tuition (Line ' || x.ln || ')', 'm': CASE WHEN x.price <> 0 THEN '฿' || format('{{:,}}', x.price) || ' / yr' ELSE 'Contact school' END}}),
  list_transform(a, lambda x: {{'l': (CASE x.flag WHEN 'A' THEN 'Application fee' WHEN 'R' THEN 'Refundable deposit' ELSE 'Lunch ' || x.st END) || ' (' || (CASE WHEN x.st = 'F' THEN 'per semester' WHEN x.qty < 10 THEN 'one-time' ELSE 'per year' END) || ')',
    'm': CASE WHEN x.qty <> 0 THEN '฿' || format('{{:,}}', x.qty * 100) ELSE 'Contact school' END}})) AS f FROM r)
SELECT school_name, cast(i - 1 AS INTEGER) AS place, f[i].l AS label, f[i].m AS amount FROM (SELECT 'Order ' || k AS school_name, f, unnest(range(1, len(f) + 1)) AS i FROM x WHERE k % 5 <> 0)
UNION ALL SELECT 'Order ' || k, 0, 'Old fee', '฿' || k FROM x WHERE k % 5 = 0""")
def fee_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_records(spark, sf_dir)
    number = F.substring_index("school_name", " ", -1)  # of every fifth record neither tiers nor costs are known, and what was there before stays
    known = lambda c: F.when(number.cast("bigint") % 5 != 0, F.col(c))
    old = F.array(F.struct(F.lit("Old fee").alias("label"), F.concat(F.lit("฿"), number).alias("amount")))
    made = rows.select("school_name", fees.replaced_if_any(fees.fee_rows(known("tuition_by_grade"), known("hidden_costs")), old).alias("rows"))
    return made.select("school_name", F.posexplode("rows").alias("place", "r")).select("school_name", "place", "r.*")


@_query(f"""SELECT d.doc_id, CASE WHEN quality = 1 THEN '{fees.SAFETY["security_guards"][0]}' ELSE '{fees.SAFETY["security_guards"][1]}' END AS guards,
  CASE WHEN toxic = 1 THEN '{fees.SAFETY["cctv_monitoring"][0]}' ELSE '{fees.SAFETY["cctv_monitoring"][1]}' END AS cctv,
  coalesce(nullif(CASE WHEN l.doc_id IS NOT NULL THEN d.source ELSE '' END, ''), nullif(d.lang, ''), 'none') AS updated FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def label_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _table(spark, sf_dir, "labels").withColumn("known", F.lit(True))
    rows = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(known, "doc_id", "left")
    return rows.select(
        "doc_id", fees.measure_text(F.col("quality") == 1, "security_guards").alias("guards"), fees.measure_text(F.col("toxic") == 1, "cctv_monitoring").alias("cctv"),
        F.coalesce(val.first_filled(F.when(F.col("known"), F.col("source")).otherwise(""), F.col("lang")), F.lit("none")).alias("updated"),
    )


_SAFE = ", ".join(f"CASE WHEN coalesce(o_orderkey % {i + 2} = 0, false) THEN '{yes}' ELSE '{no}' END AS {name}" for i, (name, (yes, no)) in enumerate(fees.SAFETY.items()))


@_query(f"""SELECT o_orderkey, {_SAFE}, '{fees.DRILL}' AS emergency_drill,
  CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority WHEN 1 THEN o_orderstatus ELSE '{fees.SUMMARY}' END AS summary,
  CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus ELSE 'old' END AS highlights, CASE o_orderkey % 3 WHEN 0 THEN 'https://new' WHEN 1 THEN 'https://old' ELSE 'https://page' END AS policy_url FROM orders""")
def safety_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    flags = [F.when(k % (i + 2) == 0, True).alias(name) for i, name in enumerate(fees.SAFETY)]
    marks = F.when(k % 4 == 0, F.array("o_orderstatus")).when(k % 4 == 1, F.array().cast("array<string>")).alias("highlights")
    record = F.struct(*flags, marks, F.when(k % 3 == 0, F.col("o_orderpriority")).otherwise("").alias("policy_summary"), F.when(k % 3 == 0, F.lit("https://new")).alias("policy_url"))
    made = fees.safety_texts(record, F.when(k % 3 == 1, F.col("o_orderstatus")), F.array(F.lit("old")), F.when(k % 3 == 1, F.lit("https://old")).otherwise(""), F.lit("https://page"))
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", made.alias("s")).select("o_orderkey", "s.*")
    return rows.withColumn("highlights", F.array_join("highlights", ","))


@_query(f"""WITH {_LINES}, m AS (SELECT k, list_transform(a, lambda x: {{'flag': x.flag, 'st': x.st, 'amt': CASE WHEN x.qty >= 10 THEN x.qty * 100 END}}) AS a FROM r)
SELECT 'Order ' || k AS school_name, list_filter(a, lambda x: x.flag = 'N')[1].amt AS application_thb,
  coalesce(list_filter(a, lambda x: x.flag = 'A' AND x.st = 'F')[1].amt, list_filter(a, lambda x: x.flag = 'A' AND x.st <> 'F')[1].amt) AS registration_thb,
  list_filter(a, lambda x: x.flag = 'R' AND x.st <> 'F')[1].amt AS deposit_thb FROM m""")
def mandatory_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    final = lambda x: x["st"] == "F"
    name = lambda x: F.when(x["flag"] == "N", "Application").when(x["flag"] == "A", F.when(final(x), "Entrance (Second and Subsequent Children)").otherwise("Entrance")).otherwise(F.when(final(x), "Boarding deposit").otherwise("Deposit"))
    cost = lambda x: F.struct(name(x).alias("name"), F.when(x["qty"] >= 10, x["qty"] * 100).alias("amount_thb"), F.lit(None).cast("string").alias("notes"))
    rows = order_lines(spark, sf_dir).select(F.concat(F.lit("Order "), F.col("k").cast("string")).alias("school_name"), F.transform("a", cost).alias("hidden_costs"))
    return costs.mandatory_cards(rows, "second_child")


@_query("""WITH p AS (SELECT c_custkey, radians(13 + (c_custkey % 1000) / 1000) AS la, radians(100 + (c_custkey % 777) / 777) AS ln, radians(13.7306) AS la0, radians(100.5688) AS ln0 FROM customer),
h AS (SELECT c_custkey, pow(sin((la - la0) / 2), 2) + cos(la0) * cos(la) * pow(sin((ln - ln0) / 2), 2) AS a FROM p) SELECT c_custkey FROM h WHERE 2 * 6371 * atan2(sqrt(a), sqrt(1 - a)) <= 40""")
def radius_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = show.within(13 + (F.col("c_custkey") % 1000) / 1000, 100 + (F.col("c_custkey") % 777) / 777, 13.7306, 100.5688, 40.0)
    return _table(spark, sf_dir, "customer").select("c_custkey").where(near)


_PLACES = """c AS (SELECT c_custkey, ((c_custkey * 37) % 1801) / 10.0 - 90 AS lat, ((c_custkey * 101) % 3600) / 10.0 - 180 AS lng FROM customer),
s AS (SELECT s_suppkey, ((s_suppkey * 53) % 1801) / 10.0 - 90 AS at_lat, ((s_suppkey * 211) % 3600) / 10.0 - 180 AS at_lng FROM supplier)"""


@_query(f"""WITH {_PLACES}, p AS (SELECT c_custkey, s_suppkey, pow(sin(radians(lat - at_lat) / 2), 2) + cos(radians(at_lat)) * cos(radians(lat)) * pow(sin(radians(lng - at_lng) / 2), 2) AS a FROM c, s)
SELECT c_custkey, s_suppkey, cast(round(2 * 6371 * atan2(sqrt(a), sqrt(greatest(0, 1 - a))), 3) AS DOUBLE) AS km FROM p WHERE 2 * 6371 * atan2(sqrt(a), sqrt(greatest(0, 1 - a))) <= 400""")
def radius_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers within 400 km of each supplier, places made of keys over the whole globe, poles and date line included."""
    place = lambda k, times, most, less: (F.col(k) * times % most) / 10.0 - less
    customers = _table(spark, sf_dir, "customer").select("c_custkey", place("c_custkey", 37, 1801, 90).alias("lat"), place("c_custkey", 101, 3600, 180).alias("lng"))
    suppliers = _table(spark, sf_dir, "supplier").select("s_suppkey", place("s_suppkey", 53, 1801, 90).alias("at_lat"), place("s_suppkey", 211, 3600, 180).alias("at_lng"))
    return near.within_each(customers, suppliers, 400).select("c_custkey", "s_suppkey", F.round("km", 3).alias("km"))


@_query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'September 2026' WHEN o_orderkey % 3 = 1 THEN 'September 2026' ELSE o_orderpriority END AS last_updated FROM orders")
def default_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.when(k == 0, "").when(k == 2, F.col("o_orderpriority")).alias("last_updated"))
    return records.with_default_date(rows, "last_updated")


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)

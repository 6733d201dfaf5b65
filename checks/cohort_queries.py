"""Windows, pivots, scores, cohort rules, codes, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query, table
from cohortflow.functions.numeric import (
    clip,
    decimal_round,
    round_half_away,
    safe_ratio,
)
from cohortflow.functions.times import calendar_years, plus, whole_hours, whole_minutes
from cohortflow.operators import codes, cohort, encode, pivot, scores, windows
from cohortflow.plans.clinical import body_mass_index, mortality
from cohortflow.session import shared_dir
from cohortflow.sources import io

# shared SQL fragments
ANCHORS = """anchors AS (
  SELECT user_id, min(ts) AS intime, max(ts) AS outtime FROM events GROUP BY user_id)"""
# a half within 1e-12 counts as one: sums in another order differ in the last bit
ROUND2 = "(sign({x}) * floor(abs({x}) * (100.0e0 * (1 + 1.0e-12)) + 0.5e0) / 100.0e0)"


def sql_sum(x: str) -> str:
    return f"sum(CAST({x} AS DOUBLE))"


def sql_avg(x: str) -> str:
    return f"avg(CAST({x} AS DOUBLE))"


def sql_round2(x: str) -> str:
    return ROUND2.format(x=x)


def anchors(spark, sf):
    """Each user's first and last event as the stay."""
    return table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("intime"), F.max("ts").alias("outtime"))


def day_one(spark, sf):
    """Events of each user within 24 hours of the first."""
    a = anchors(spark, sf).withColumn("day_end", plus(F.col("intime"), hours=24))
    ev = table(spark, sf, "events").select("user_id", "ts", "event_type", "value")
    return windows.events_in_window(a, ev, ["user_id"], "ts", "intime", "day_end")


DAY_ONE = f"""{ANCHORS}, day_one AS (
  SELECT a.user_id, a.intime, a.outtime, e.ts, e.event_type, e.value FROM anchors a JOIN events e ON a.user_id = e.user_id
  AND e.ts BETWEEN a.intime AND a.intime + INTERVAL '24' HOUR)"""


@query("item_scan", """SELECT event_id, user_id, ts, event_type, value FROM events
  WHERE event_type IN ('view', 'purchase') AND value IS NOT NULL AND value BETWEEN 1 AND 90""")
def item_scan(spark, sf):
    items = [pivot.Feature("x", ("view", "purchase"))]
    rows = pivot.scan_items(table(spark, sf, "events"), items, "event_type", "value", ["event_id", "user_id", "ts"])
    return cohort.within(rows, "value", 1, 90)


@query("second_source_scan", """SELECT l_orderkey, l_partkey, 'returned' AS kind, l_extendedprice AS value FROM lineitem
  WHERE l_returnflag = 'R' AND l_extendedprice BETWEEN 1000 AND 50000
  UNION ALL SELECT l_orderkey, l_partkey, 'taxed', l_tax FROM lineitem WHERE l_linestatus = 'O' AND l_tax > 0.05""")
def second_source_scan(spark, sf):
    li = table(spark, sf, "lineitem")
    returned = cohort.within(li.where(F.col("l_returnflag") == "R"), "l_extendedprice", 1000, 50000)
    taxed = li.where((F.col("l_linestatus") == "O") & (F.col("l_tax") > 0.05))
    pick = ["l_orderkey", "l_partkey"]
    return io.union_all(
        [
            returned.select(*pick, F.lit("returned").alias("kind"), F.col("l_extendedprice").alias("value")),
            taxed.select(*pick, F.lit("taxed").alias("kind"), F.col("l_tax").alias("value")),
        ]
    )


@query("csv_roundtrip", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders")
def csv_roundtrip(spark, sf):
    path = shared_dir(spark)
    io.write_table(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), path, "csv")
    return io.read_csv(spark, path, "o_orderkey long, o_orderpriority string, o_totalprice double")


@query("json_roundtrip", f"""SELECT event_type, count(*) AS n, round({sql_sum("value")}, 4) AS total FROM events GROUP BY event_type""")
def json_roundtrip(spark, sf):
    path = shared_dir(spark)
    small = table(spark, sf, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")
    )
    io.write_table(small, path, "json")
    return io.read_json(spark, path, "event_type string, n long, total double")


@query("sparse_triplets", """WITH cells AS (
  SELECT l_orderkey, l_partkey, unnest(['l_quantity', 'l_discount', 'l_tax']) AS col,
    unnest([l_quantity, l_discount, l_tax]) AS value FROM lineitem)
  SELECT * FROM cells WHERE value <> 0""")
def sparse_triplets(spark, sf):
    return io.triplets(table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey"], ["l_quantity", "l_discount", "l_tax"])


MINMAX = [
    pivot.Feature("view_min", ("view",), "min"),
    pivot.Feature("view_max", ("view",), "max"),
    pivot.Feature("click_max", ("click",), "max"),
    pivot.Feature("money_max", ("purchase", "signup"), "max"),
    pivot.Feature("error_min", ("error",), "min"),
]


def minmax(spark, sf):
    a = anchors(spark, sf)
    wide = pivot.pivot_features(day_one(spark, sf), ["user_id"], MINMAX, "event_type", "value")
    return windows.attach(a.select("user_id"), [wide], ["user_id"])


MINMAX_SQL = f"""{DAY_ONE}, wide AS (
  SELECT a.user_id, min(CASE WHEN event_type = 'view' THEN value END) AS view_min,
    max(CASE WHEN event_type = 'view' THEN value END) AS view_max,
    max(CASE WHEN event_type = 'click' THEN value END) AS click_max,
    max(CASE WHEN event_type IN ('purchase', 'signup') THEN value END) AS money_max,
    min(CASE WHEN event_type = 'error' THEN value END) AS error_min
  FROM anchors a LEFT JOIN day_one d ON a.user_id = d.user_id GROUP BY a.user_id)"""


@query("window_minmax_pivot", f"WITH {MINMAX_SQL} SELECT * FROM wide")
def window_minmax_pivot(spark, sf):
    return minmax(spark, sf)


@query("window_avg_pivot", f"""WITH {DAY_ONE} SELECT user_id,
  {sql_round2(sql_avg("CASE WHEN event_type = 'view' AND value BETWEEN 0 AND 60 THEN value END"))} AS view_avg,
  {sql_round2(sql_avg("CASE WHEN event_type = 'click' AND (value - 32) * 5.0e0 / 9.0e0 BETWEEN 0 AND 42 THEN (value - 32) * 5.0e0 / 9.0e0 END"))} AS click_celsius,
  {sql_round2(sql_avg("CASE WHEN event_type IN ('purchase', 'signup') AND value <= 90 THEN value END"))} AS money_avg,
  {sql_round2(sql_avg("CASE WHEN event_type = 'error' AND value > 5 THEN value END"))} AS error_avg
  FROM day_one GROUP BY user_id""")
def window_avg_pivot(spark, sf):
    features = [
        pivot.Feature("view_avg", ("view",), low=0, high=60),
        pivot.Feature("click_celsius", ("click",), low=0, high=42, transform=lambda v: (v - 32) * 5.0 / 9.0),
        pivot.Feature("money_avg", ("purchase", "signup"), high=90),
        pivot.Feature("error_avg", ("error",), low=5, low_open=True),
    ]
    return pivot.pivot_features(day_one(spark, sf), ["user_id"], features, "event_type", "value")


@query("two_source_preagg", """WITH a AS (
    SELECT o_custkey, min(o_orderdate) AS d0 FROM orders GROUP BY o_custkey),
  o AS (SELECT a.o_custkey, x.o_totalprice FROM a JOIN orders x ON a.o_custkey = x.o_custkey
    AND x.o_orderdate BETWEEN a.d0 AND a.d0 + INTERVAL '8760' HOUR),
  l AS (SELECT a.o_custkey, li.l_quantity FROM a JOIN orders x ON a.o_custkey = x.o_custkey JOIN lineitem li
    ON li.l_orderkey = x.o_orderkey AND li.l_shipdate BETWEEN a.d0 AND a.d0 + INTERVAL '8760' HOUR)
  SELECT a.o_custkey, min(o.o_totalprice) AS price_min, max(o.o_totalprice) AS price_max, max(l.l_quantity) AS qty_max
  FROM a LEFT JOIN o ON a.o_custkey = o.o_custkey LEFT JOIN l ON a.o_custkey = l.o_custkey GROUP BY a.o_custkey""")
def two_source_preagg(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    a = o.groupBy("o_custkey").agg(F.min("o_orderdate").alias("d0")).withColumn("d1", plus(F.col("d0"), days=365))
    orders = o.select("o_custkey", "o_orderdate", "o_totalprice")
    items = li.select("l_orderkey", "l_shipdate", "l_quantity").join(
        o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey"
    )
    prices = windows.events_in_window(a, orders, ["o_custkey"], "o_orderdate", "d0", "d1")
    lines = windows.events_in_window(a, items.drop("l_orderkey"), ["o_custkey"], "l_shipdate", "d0", "d1")
    parts = [
        prices.groupBy("o_custkey").agg(F.min("o_totalprice").alias("price_min"), F.max("o_totalprice").alias("price_max")),
        lines.groupBy("o_custkey").agg(F.max("l_quantity").alias("qty_max")),
    ]
    return windows.attach(a.select("o_custkey"), parts, ["o_custkey"])


SCORE = [
    scores.Component("view_score", (("view_min < 20", 1), ("view_max > 80", 1))),
    scores.Component("click_score", (("click_max > 90", 6), ("click_max < 10", 4), ("click_max BETWEEN 50 AND 89", 3)), needs="click_max"),
    scores.Component("money_score", (("money_max >= 40", 1),)),
]
SCORE_SQL = """scored AS (SELECT user_id,
    CASE WHEN view_min < 20 THEN 1 WHEN view_max > 80 THEN 1 ELSE 0 END AS view_score,
    CASE WHEN click_max IS NULL THEN NULL WHEN click_max > 90 THEN 6 WHEN click_max < 10 THEN 4
      WHEN click_max BETWEEN 50 AND 89 THEN 3 ELSE 0 END AS click_score,
    CASE WHEN money_max >= 40 THEN 1 ELSE 0 END AS money_score FROM wide),
  totals AS (SELECT *, coalesce(view_score, 0) + coalesce(click_score, 0) + coalesce(money_score, 0) AS total FROM scored)"""


@query("rule_score", f"WITH {MINMAX_SQL}, {SCORE_SQL} SELECT * FROM totals")
def rule_score(spark, sf):
    wide = scores.score(minmax(spark, sf), SCORE, "total")
    return wide.select("user_id", "view_score", "click_score", "money_score", "total")


def labelled(spark, sf):
    scored = scores.score(minmax(spark, sf), SCORE, "total")
    money = F.col("money_score") >= 1
    high = F.col("total") >= 2
    label = scores.first_match([(money & high, F.lit("both")), (high, F.lit("high"))], F.lit("none"))
    return scored.withColumn("label", label).select("user_id", "total", "label")


@query("cohort_label", f"""WITH {MINMAX_SQL}, {SCORE_SQL}, l AS (SELECT user_id, total, CASE
    WHEN money_score >= 1 AND total >= 2 THEN 'both' WHEN total >= 2 THEN 'high' ELSE 'none' END AS label FROM totals)
  SELECT * FROM l WHERE label IN ('both', 'high')""")
def cohort_label(spark, sf):
    return labelled(spark, sf).where(F.col("label").isin("both", "high"))


GCS = [pivot.Feature("a", ("view",)), pivot.Feature("b", ("click",)), pivot.Feature("c", ("error",))]


@query("gcs_style_sum", f"""WITH {DAY_ONE}, m AS (SELECT user_id,
    {sql_avg("CASE WHEN event_type = 'view' THEN value END")} AS a,
    {sql_avg("CASE WHEN event_type = 'click' THEN value END")} AS b,
    {sql_avg("CASE WHEN event_type = 'error' THEN value END")} AS c
    FROM day_one GROUP BY user_id)
  SELECT user_id, {sql_round2("(coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0))")} AS total,
    {sql_round2("(a / nullif(b, 0))")} AS ratio FROM m""")
def gcs_style_sum(spark, sf):
    return day_one(spark, sf).groupBy("user_id").agg(
        pivot.coalesced_total(GCS, "event_type", "value").alias("total"),
        pivot.ratio_of_means(GCS[0], GCS[1], "event_type", "value").alias("ratio"),
    )


@query("first_per_subject", """SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders
  WHERE o_totalprice > 200000) WHERE rn = 1""")
def first_per_subject(spark, sf):
    o = table(spark, sf, "orders").where(F.col("o_totalprice") > 200000)
    rows = o.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return cohort.first_per_key(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("anti_exclude", """SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (
  SELECT o_custkey FROM orders WHERE regexp_matches(o_orderpriority, '^(1-URG|5)') AND o_orderstatus = 'P')""")
def anti_exclude(spark, sf):
    bad = table(spark, sf, "orders").where(F.col("o_orderpriority").rlike("^(1-URG|5)") & (F.col("o_orderstatus") == "P"))
    people = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return cohort.exclude(people, bad.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("duration_filter", f"""WITH {ANCHORS}, d AS (SELECT user_id,
    date_sub('hour', intime, outtime) AS hours, date_sub('minute', intime, outtime) AS minutes FROM anchors)
  SELECT * FROM d WHERE hours BETWEEN 24 AND 2400""")
def duration_filter(spark, sf):
    spans = anchors(spark, sf).select(
        "user_id",
        whole_hours(F.col("intime"), F.col("outtime")).alias("hours"),
        whole_minutes(F.col("intime"), F.col("outtime")).alias("minutes"),
    )
    return cohort.within(spans, "hours", 24, 2400)


@query("attrition_funnel", """WITH r AS (SELECT o_custkey, o_orderkey,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) > 1 AS late,
    o_orderstatus = 'P' AS pending, o_totalprice < 30000 AS small FROM orders),
  s1 AS (SELECT * FROM r WHERE NOT late), s2 AS (SELECT * FROM s1 WHERE NOT pending),
  s3 AS (SELECT * FROM s2 WHERE NOT small),
  c AS (SELECT (SELECT count(DISTINCT o_custkey) FROM r) AS p0, (SELECT count(*) FROM r) AS n0,
    (SELECT count(DISTINCT o_custkey) FROM s1) AS p1, (SELECT count(*) FROM s1) AS n1,
    (SELECT count(DISTINCT o_custkey) FROM s2) AS p2, (SELECT count(*) FROM s2) AS n2,
    (SELECT count(DISTINCT o_custkey) FROM s3) AS p3, (SELECT count(*) FROM s3) AS n3)
  SELECT 1 AS step_num, 'Initial dataset' AS step, p0 AS subject_count, n0 AS stay_count FROM c
  UNION ALL SELECT 2, 'late', p0 - p1, n0 - n1 FROM c UNION ALL SELECT 3, 'After: late', p1, n1 FROM c
  UNION ALL SELECT 4, 'pending', p1 - p2, n1 - n2 FROM c UNION ALL SELECT 5, 'After: pending', p2, n2 FROM c
  UNION ALL SELECT 6, 'small', p2 - p3, n2 - n3 FROM c UNION ALL SELECT 7, 'After: small', p3, n3 FROM c""")
def attrition_funnel(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    firsts = cohort.first_per_key(o.select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    o = o.join(firsts.select("o_orderkey", F.lit(True).alias("is_first")), "o_orderkey", "left")
    rules = [
        ("late", F.col("is_first").isNull()),
        ("pending", F.col("o_orderstatus") == "P"),
        ("small", F.col("o_totalprice") < 30000),
    ]
    return cohort.attrition(o, "o_custkey", rules)


INTERVALS = """iv AS (SELECT o_custkey, o_orderkey AS iv_key, o_orderdate AS iv_start,
    o_orderdate + INTERVAL '1' DAY * (o_orderkey % 90) AS iv_end FROM orders WHERE o_orderstatus = 'F')"""


def intervals(spark, sf):
    o = table(spark, sf, "orders").where(F.col("o_orderstatus") == "F")
    end = F.expr("o_orderdate + INTERVAL '1' DAY * (o_orderkey % 90)")
    return o.select("o_custkey", F.col("o_orderkey").alias("iv_key"), F.col("o_orderdate").alias("iv_start"), end.alias("iv_end"))


@query("point_in_interval", f"""WITH {INTERVALS} SELECT o.o_orderkey, iv.iv_key,
    date_sub('minute', iv.iv_start, o.o_orderdate) AS minutes_before FROM orders o JOIN iv
  ON o.o_custkey = iv.o_custkey AND o.o_orderdate BETWEEN iv.iv_start AND iv.iv_end WHERE o.o_orderstatus = 'O'""")
def point_in_interval(spark, sf):
    points = table(spark, sf, "orders").where(F.col("o_orderstatus") == "O").select("o_orderkey", "o_custkey", "o_orderdate")
    hits = windows.points_in_intervals(points, intervals(spark, sf), ["o_custkey"], "o_orderdate", "iv_start", "iv_end")
    return hits.select("o_orderkey", "iv_key", whole_minutes(F.col("iv_start"), F.col("o_orderdate")).alias("minutes_before"))


@query("one_sided_flag", f"""WITH {ANCHORS} SELECT a.user_id, max(CASE WHEN e.event_type LIKE '%urch%' OR e.event_type = 'error'
    THEN 1 ELSE 0 END) AS flag FROM anchors a LEFT JOIN events e ON a.user_id = e.user_id
  AND e.ts < a.intime + INTERVAL '24' HOUR GROUP BY a.user_id""")
def one_sided_flag(spark, sf):
    a = anchors(spark, sf).withColumn("day_end", plus(F.col("intime"), days=1))
    kind = F.col("event_type")
    ev = table(spark, sf, "events").where(F.lower(kind).like("%urch%") | (kind == "error")).select("user_id", "ts")
    hits = windows.events_in_window(a, ev, ["user_id"], "ts", None, "day_end", end_open=True)
    return windows.any_match(a.select("user_id"), [hits], ["user_id"], "flag")


@query("overlap_exists", f"""WITH {ANCHORS} SELECT a.user_id, CASE
    WHEN EXISTS (SELECT 1 FROM events e WHERE e.user_id = a.user_id AND e.event_type = 'error' AND e.value > 50
      AND e.ts BETWEEN a.intime AND a.intime + INTERVAL '24' HOUR)
    OR EXISTS (SELECT 1 FROM events e WHERE e.user_id = a.user_id AND e.event_type = 'view' AND e.value > 60
      AND e.ts + INTERVAL '2' HOUR >= a.intime + INTERVAL '12' HOUR AND e.ts <= a.intime + INTERVAL '36' HOUR)
    OR EXISTS (SELECT 1 FROM events e WHERE e.user_id = a.user_id AND e.event_type = 'signup' AND e.value > 90
      AND e.ts + INTERVAL '6' HOUR >= a.intime AND e.ts <= a.intime + INTERVAL '24' HOUR)
    THEN 1 ELSE 0 END AS flag FROM anchors a""")
def overlap_exists(spark, sf):
    a = anchors(spark, sf)
    t = F.col("intime")
    a = a.withColumns({"d1": plus(t, hours=24), "h12": plus(t, hours=12), "h36": plus(t, hours=36)})
    ev = table(spark, sf, "events")

    def of(kind, low, hours=0):
        picked = ev.where((F.col("event_type") == kind) & (F.col("value") > low))
        return picked.select("user_id", "ts", plus(F.col("ts"), hours=hours).alias("te"))

    parts = [
        windows.events_in_window(a, of("error", 50), ["user_id"], "ts", "intime", "d1"),
        windows.intervals_overlapping(a, of("view", 60, 2), ["user_id"], "ts", "te", "h12", "h36"),
        windows.intervals_overlapping(a, of("signup", 90, 6), ["user_id"], "ts", "te", "intime", "d1"),
    ]
    return windows.any_match(a.select("user_id"), parts, ["user_id"], "flag")


@query("full_outer_merge", """WITH cm AS (SELECT user_id, date_trunc('hour', ts) AS t, value AS cm FROM events
    WHERE event_type = 'view' AND value BETWEEN 20 AND 90),
  inch AS (SELECT user_id, date_trunc('hour', ts) AS t, CAST(round(CAST(value * 2.54e0 AS DECIMAL(38,9)), 2) AS DOUBLE) AS inch
    FROM events WHERE event_type = 'click' AND value BETWEEN 5 AND 40),
  m AS (SELECT coalesce(cm.user_id, inch.user_id) AS user_id, coalesce(cm.cm, inch.inch) AS h
    FROM cm FULL JOIN inch ON cm.user_id = inch.user_id AND cm.t = inch.t)
  SELECT user_id, quantile_disc(h, 0.5) AS height, count(*) AS n FROM m WHERE h BETWEEN 20 AND 90 GROUP BY user_id""")
def full_outer_merge(spark, sf):
    ev = table(spark, sf, "events").withColumn("t", F.date_trunc("hour", "ts"))
    v = F.col("value")
    cm = ev.where((F.col("event_type") == "view") & v.between(20, 90)).select("user_id", "t", v.alias("cm"))
    inch = ev.where((F.col("event_type") == "click") & v.between(5, 40)).select(
        "user_id", "t", decimal_round(v * 2.54, 2).cast("double").alias("inch")
    )
    merged = cm.join(inch, ["user_id", "t"], "full").withColumn("h", F.coalesce("cm", "inch"))
    rows = merged.where(F.col("h").between(20, 90))
    return rows.groupBy("user_id").agg(F.percentile_approx("h", 0.5).alias("height"), F.count(F.lit(1)).alias("n"))


BOOK = [
    codes.Prefixes("low_brand", "brand_code", 7, tuple(f"Brand#{i}" for i in (1, 2, 3))),
    codes.Prefixes("mid_brand", "brand_code", 8, between=("Brand#10", "Brand#14")),
    codes.Prefixes("mid_brand", "type_code", 3, ("PRO",)),
    codes.Prefixes("short_literal", "type_code", 4, ("SM", "STAN")),
]


@query("code_prefix_flags", """WITH c AS (SELECT li.l_orderkey, CASE WHEN p.p_size % 2 = 0 THEN p.p_brand END AS brand_code,
    CASE WHEN p.p_size % 2 = 1 THEN p.p_type END AS type_code FROM lineitem li JOIN part p ON li.l_partkey = p.p_partkey)
  SELECT l_orderkey,
    max(CASE WHEN substr(brand_code, 1, 7) IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 1 ELSE 0 END) AS low_brand,
    max(CASE WHEN substr(brand_code, 1, 8) BETWEEN 'Brand#10' AND 'Brand#14' OR substr(type_code, 1, 3) = 'PRO'
      THEN 1 ELSE 0 END) AS mid_brand,
    max(CASE WHEN substr(type_code, 1, 4) IN ('SM', 'STAN') THEN 1 ELSE 0 END) AS short_literal
  FROM c GROUP BY l_orderkey""")
def code_prefix_flags(spark, sf):
    part = table(spark, sf, "part").withColumn("version", F.col("p_size") % 2)
    brand = codes.split_versions(part, "p_brand", "version", {0: "brand_code"})
    split = codes.split_versions(brand, "p_type", "version", {1: "type_code"}).select(
        F.col("p_partkey").alias("l_partkey"), "brand_code", "type_code"
    )
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(split, "l_partkey")
    return codes.code_flags(lines, ["l_orderkey"], BOOK)


@query("dose_standardise", """WITH r AS (SELECT l_orderkey, CASE
    WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN CAST(round(CAST(l_quantity AS DECIMAL(38,9)), 3) AS DOUBLE)
    WHEN l_returnflag = 'A' THEN CAST(round(CAST(l_quantity / 80.0e0 AS DECIMAL(38,9)), 3) AS DOUBLE)
    WHEN l_returnflag = 'N' AND l_quantity > 20 THEN CAST(round(CAST(l_quantity * 5.0e0 / 60.0e0 AS DECIMAL(38,9)), 3) AS DOUBLE)
    WHEN l_returnflag = 'N' AND l_quantity < 20 THEN CAST(round(CAST(l_quantity * 5.0e0 AS DECIMAL(38,9)), 3) AS DOUBLE)
    END AS rate FROM lineitem)
  SELECT l_orderkey, max(rate) AS max_rate, max(CASE WHEN rate IS NOT NULL THEN 1 ELSE 0 END) AS any_rate
  FROM r GROUP BY l_orderkey""")
def dose_standardise(spark, sf):
    q, flag = F.col("l_quantity"), F.col("l_returnflag")
    rules = [
        ((flag == "A") & (F.col("l_linestatus") == "F"), q),
        (flag == "A", q / 80.0),
        ((flag == "N") & (q > 20), q * 5.0 / 60.0),
        ((flag == "N") & (q < 20), q * 5.0),
    ]
    rate = scores.first_match([(c, decimal_round(x, 3).cast("double")) for c, x in rules])
    rows = table(spark, sf, "lineitem").select("l_orderkey", rate.alias("rate"))
    return rows.groupBy("l_orderkey").agg(
        F.max("rate").alias("max_rate"), F.max(F.when(F.col("rate").isNotNull(), 1).otherwise(0)).alias("any_rate")
    )


@query("horizon_labels", """WITH a AS (SELECT o_custkey, min(o_orderdate) AS d0 FROM orders GROUP BY o_custkey),
  z AS (SELECT o_custkey, CAST(max(o_orderdate) AS DATE) AS dod FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey)
  SELECT a.o_custkey, CASE WHEN dod <= d0 + INTERVAL '2' DAY THEN 1 ELSE 0 END AS d48h,
    CASE WHEN dod <= d0 + INTERVAL '90' DAY THEN 1 ELSE 0 END AS d90d,
    CASE WHEN dod IS NOT NULL THEN 1 ELSE 0 END AS dinhosp FROM a LEFT JOIN z ON a.o_custkey = z.o_custkey""")
def horizon_labels(spark, sf):
    o = table(spark, sf, "orders")
    pending = F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate"))
    a = o.groupBy("o_custkey").agg(F.min("o_orderdate").alias("d0"), F.max(pending).cast("date").alias("dod"))
    return a.withColumns(mortality(F.col("dod"), F.col("d0"))).select("o_custkey", "d48h", "d90d", "dinhosp")


@query("year_diff_age", """SELECT o_orderkey, CAST(20 + o_custkey % 60 + (year(o_orderdate) - (1990 + o_custkey % 8)) AS BIGINT) AS age
  FROM orders""")
def year_diff_age(spark, sf):
    anchor_age, anchor_year = 20 + F.col("o_custkey") % 60, 1990 + F.col("o_custkey") % 8
    age = anchor_age + calendar_years(anchor_year, F.col("o_orderdate"))
    return table(spark, sf, "orders").select("o_orderkey", age.cast("long").alias("age"))


@query("star_assembly", f"""WITH {DAY_ONE},
  v AS (SELECT user_id, max(value) AS view_max FROM day_one WHERE event_type = 'view' GROUP BY user_id),
  c AS (SELECT user_id, round({sql_sum("value")}, 4) AS click_sum FROM day_one WHERE event_type = 'click' GROUP BY user_id),
  e AS (SELECT user_id, count(*) AS errors FROM day_one WHERE event_type = 'error' GROUP BY user_id),
  p AS (SELECT user_id, min(ts) AS first_purchase FROM events WHERE event_type = 'purchase' GROUP BY user_id),
  s AS (SELECT user_id, {sql_round2(sql_avg("value"))} AS signup_avg FROM events WHERE event_type = 'signup' GROUP BY user_id),
  n AS (SELECT user_id, count(*) AS n_events FROM events GROUP BY user_id)
  SELECT DISTINCT a.user_id, n_events, view_max, click_sum, coalesce(errors, 0) AS errors, first_purchase, signup_avg,
    CASE WHEN click_sum > 0 THEN {sql_round2("(view_max / pow(click_sum / 100, 2.0e0))")} END AS index_like
  FROM anchors a LEFT JOIN v ON a.user_id = v.user_id LEFT JOIN c ON a.user_id = c.user_id
    LEFT JOIN e ON a.user_id = e.user_id LEFT JOIN p ON a.user_id = p.user_id LEFT JOIN s ON a.user_id = s.user_id
    LEFT JOIN n ON a.user_id = n.user_id ORDER BY a.user_id""")
def star_assembly(spark, sf):
    day, ev, key = day_one(spark, sf), table(spark, sf, "events"), ["user_id"]

    def of(df, kind):
        return df.where(F.col("event_type") == kind).groupBy("user_id")

    parts = [
        of(day, "view").agg(F.max("value").alias("view_max")),
        of(day, "click").agg(F.round(F.sum("value"), 4).alias("click_sum")),
        of(day, "error").agg(F.count(F.lit(1)).alias("errors")),
        of(ev, "purchase").agg(F.min("ts").alias("first_purchase")),
        of(ev, "signup").agg(round_half_away(F.avg(F.col("value"))).alias("signup_avg")),
        ev.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events")),
    ]
    wide = windows.attach(anchors(spark, sf).select("user_id"), parts, key, fill={"errors": 0})
    index = round_half_away(F.col("view_max") / F.pow(F.col("click_sum") / 100, F.lit(2.0)))
    wide = wide.select("*", F.when(F.col("click_sum") > 0, index).alias("index_like"))
    return wide.distinct().orderBy("user_id")


@query("dim_attach", """SELECT o.o_orderkey, c.c_mktsegment, n.n_name, r.r_name, f.l_partkey AS first_part FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey AND r.r_name <> 'ASIA'
  LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS l_partkey FROM lineitem WHERE l_linenumber = 1 GROUP BY l_orderkey) f
    ON f.l_orderkey = o.o_orderkey""")
def dim_attach(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment")
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    r = table(spark, sf, "region").where(F.col("r_name") != "ASIA").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    primary = table(spark, sf, "lineitem").where(F.col("l_linenumber") == 1).select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    first = cohort.first_per_key(primary, ["o_orderkey"], ["l_partkey"]).withColumnRenamed("l_partkey", "first_part")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    joined = o.join(c, "o_custkey").join(n, "c_nationkey").join(r, "n_regionkey", "left").join(first, "o_orderkey", "left")
    return joined.select("o_orderkey", "c_mktsegment", "n_name", "r_name", "first_part")


@query("flag_and_sum", f"""WITH {ANCHORS}, x AS (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase')
  SELECT a.user_id, max(CASE WHEN x.ts IS NOT NULL THEN 1 ELSE 0 END) AS any_purchase, round({sql_sum("x.value")}, 4) AS total
  FROM anchors a LEFT JOIN x ON a.user_id = x.user_id AND x.ts BETWEEN a.intime AND a.intime + INTERVAL '24' HOUR
  GROUP BY a.user_id""")
def flag_and_sum(spark, sf):
    features = [pivot.Feature("any_purchase", ("purchase",), "flag"), pivot.Feature("total", ("purchase",), "sum")]
    wide = pivot.pivot_features(day_one(spark, sf), ["user_id"], features, "event_type", "value")
    out = windows.attach(anchors(spark, sf).select("user_id"), [wide], ["user_id"], fill={"any_purchase": 0})
    return out.withColumn("total", F.round("total", 4))


@query("bounded_avg", f"""SELECT c.c_custkey, {sql_round2(sql_avg("o.o_totalprice"))} AS avg_price FROM customer c
  LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice IS NOT NULL AND o.o_totalprice BETWEEN 3000 AND 300000
  GROUP BY c.c_custkey""")
def bounded_avg(spark, sf):
    o = cohort.within(table(spark, sf, "orders"), "o_totalprice", 3000, 300000)
    people = table(spark, sf, "customer").select("c_custkey")
    rows = people.join(o, F.col("c_custkey") == F.col("o_custkey"))
    return rows.groupBy("c_custkey").agg(round_half_away(F.avg(F.col("o_totalprice"))).alias("avg_price"))


@query("key_intersect", """SELECT l_orderkey FROM lineitem WHERE l_quantity > 40 INTERSECT
  SELECT l_orderkey FROM lineitem WHERE l_discount > 0.08""")
def key_intersect(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy("l_orderkey").agg(
        F.max((F.col("l_quantity") > 40).cast("int")).alias("a"), F.max((F.col("l_discount") > 0.08).cast("int")).alias("b")
    ).where((F.col("a") == 1) & (F.col("b") == 1)).select("l_orderkey")


@query("scalar_suite", f"""SELECT o_orderkey, o_orderdate + INTERVAL '24' HOUR AS next_day, o_orderdate - INTERVAL '36' HOUR AS earlier,
    make_timestamp(year(o_orderdate), 1, 1, 0, 0, 0.0e0) AS year_start,
    {sql_round2("(o_totalprice / 7.0e0)")} AS rounded,
    CAST(round(CAST(o_totalprice / 7.0e0 AS DECIMAL(38,9)), 3) AS DOUBLE) AS exact,
    coalesce(nullif(o_orderstatus, 'P'), 'none') AS status, abs(o_totalprice - 250000) AS away,
    {sql_round2("pow(o_totalprice / 100000, 2.0e0)")} AS squared, lower(o_orderpriority) AS low, substr(o_orderpriority, 1, 3) AS head,
    CASE WHEN o_orderpriority LIKE '%HIGH%' THEN 1 ELSE 0 END AS is_high,
    CASE WHEN regexp_matches(o_orderpriority, '^[12]') THEN 1 ELSE 0 END AS is_top,
    CASE WHEN substr(o_orderpriority, 1, 1) BETWEEN '2' AND '4' THEN 1 ELSE 0 END AS is_mid,
    (2 * o_totalprice + 1000) / 3 AS mean_pressure, least(greatest(o_totalprice, 50000.0e0), 400000.0e0) AS clipped,
    1000.0e0 / nullif(o_orderkey % 3, 0) AS ratio, printf('%.2e', o_totalprice) AS sci FROM orders""")
def scalar_suite(spark, sf):
    price, pri = F.col("o_totalprice"), F.col("o_orderpriority")

    def flag(c):
        return F.when(c, 1).otherwise(0)

    return table(spark, sf, "orders").select(
        "o_orderkey",
        plus(F.col("o_orderdate"), days=1).alias("next_day"),
        plus(F.col("o_orderdate"), hours=-36).alias("earlier"),
        F.date_trunc("year", "o_orderdate").cast("timestamp_ntz").alias("year_start"),
        round_half_away(price / 7.0).alias("rounded"),
        decimal_round(price / 7.0, 3).cast("double").alias("exact"),
        F.coalesce(F.nullif(F.col("o_orderstatus"), F.lit("P")), F.lit("none")).alias("status"),
        F.abs(price - 250000).alias("away"),
        round_half_away(F.pow(price / 100000, F.lit(2.0))).alias("squared"),
        F.lower(pri).alias("low"),
        F.substring(pri, 1, 3).alias("head"),
        flag(pri.like("%HIGH%")).alias("is_high"),
        flag(pri.rlike("^[12]")).alias("is_top"),
        flag(F.substring(pri, 1, 1).between("2", "4")).alias("is_mid"),
        ((2 * price + 1000) / 3).alias("mean_pressure"),
        clip(price, 50000.0, 400000.0).alias("clipped"),
        safe_ratio(F.lit(1000.0), F.col("o_orderkey") % 3).alias("ratio"),
        F.format_string("%.2e", price).alias("sci"),
    )


@query("body_mass", f"""SELECT l_orderkey, l_partkey, l_quantity, CASE WHEN l_quantity > 25 AND h > 0 THEN
    CASE WHEN {sql_round2("(l_quantity / ((h / 100) * (h / 100)))")} BETWEEN 0 AND 100
      THEN {sql_round2("(l_quantity / ((h / 100) * (h / 100)))")} END END AS bmi
  FROM (SELECT *, CAST(l_partkey % 200 AS DOUBLE) AS h FROM lineitem)""")
def body_mass(spark, sf):
    height = (F.col("l_partkey") % 200).cast("double")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return li.withColumn("bmi", body_mass_index(F.col("l_quantity"), height))


@query("encode_map", """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 0 END AS segment,
    CASE WHEN c_nationkey = 7 THEN 1 ELSE 0 END AS home FROM customer""")
def encode_map(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey",
        encode.map_values(F.col("c_mktsegment"), {"BUILDING": 1, "MACHINERY": 0}).alias("segment"),
        encode.map_values(F.col("c_nationkey"), {7: 1}, F.lit(0)).alias("home"),
    )


@query("encode_contains", """SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN 0
    WHEN upper(p_name) LIKE '%RED%' OR upper(p_name) LIKE '%HOT%' THEN 1 WHEN upper(p_name) LIKE '%BLUE%' THEN 2
    WHEN upper(p_name) LIKE '%GEAR%' THEN 3 ELSE 0 END AS kind FROM part""")
def encode_contains(spark, sf):
    name = F.when(F.col("p_size") % 9 != 0, F.col("p_name"))
    needles = [(("RED", "HOT"), 1), (("BLUE",), 2), (("GEAR",), 3)]
    return table(spark, sf, "part").select("p_partkey", encode.map_contains(name, needles, F.lit(0)).alias("kind"))

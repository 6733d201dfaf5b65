"""Encoding, profiling, missing values, outliers, splits, metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.cohort_queries import sql_avg, sql_round2, sql_sum
from checks.registry import query, table
from cohortflow.functions.distributions import cdf_column, normal_cdf_column, normal_quantile_column
from cohortflow.functions.numeric import round_half_away
from cohortflow.operators import dist, encode, metrics, missing, ordered, outliers, profile, split
from cohortflow.plans import analysis, store
from cohortflow.session import shared_dir
from cohortflow.sources import io

# orders with gaps made by rule; the same expressions run on both engines
MESSY_COLUMNS = {
    "o_orderkey": "o_orderkey",
    "status": "o_orderstatus",
    "price": "CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END",
    "cust": "CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 14 <> 0 THEN CAST(o_custkey AS DOUBLE) END",
    "age": "CASE WHEN o_custkey % 4 <> 0 THEN CAST(o_custkey % 90 AS DOUBLE) END",
    "flag": "CASE WHEN o_orderkey % 35 <> 1 THEN CASE WHEN o_orderkey % 10 = 0 THEN 1.0e0 ELSE 0.0e0 END END",
    "steps": "CAST(o_orderkey % 13 AS DOUBLE)",
}
GAPPY = ["price", "cust", "age", "flag", "steps"]
MESSY = "messy AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in MESSY_COLUMNS.items()) + " FROM orders)"
MISSING = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in GAPPY)


def messy(spark, sf):
    return table(spark, sf, "orders").selectExpr(*[f"{e} AS {n}" for n, e in MESSY_COLUMNS.items()])


@query("one_hot", """SELECT o_orderkey, """ + ", ".join(
    f"""CASE WHEN o_orderpriority = '{p}' THEN 1.0e0 ELSE 0.0e0 END AS "o_orderpriority_{p}" """
    for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " FROM orders")
def one_hot(spark, sf):
    return encode.one_hot(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], most=50)


@query("missing_count", f"WITH {MESSY} SELECT *, {MISSING} AS missing_count FROM messy")
def missing_count(spark, sf):
    return encode.add_missing_count(messy(spark, sf), columns=GAPPY)


@query("completeness", f"""WITH {MESSY} SELECT o_orderkey, price, cust FROM messy WHERE 5 - ({MISSING}) >= 4
  AND (CASE WHEN price IS NULL THEN 0 ELSE 1 END + CASE WHEN cust IS NULL THEN 0 ELSE 1 END) >= 1""")
def completeness(spark, sf):
    kept = encode.keep_complete(messy(spark, sf), [GAPPY, ["price", "cust"]], 0.8)
    return kept.select("o_orderkey", "price", "cust")


def sql_summary(table_name: str, column: str, numeric: bool, quoted: bool = True) -> str:
    if not numeric:
        none = ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in ("mean", "variance", "std_dev", "median", '"min"', '"max"', '"sum"'))
        return f"SELECT '{column}' AS \"column\", 'Categorical' AS type, {none}, count({column}) AS \"count\" FROM {table_name}"
    parts = {
        "mean": sql_avg(column),
        "variance": f"var_samp({column})",
        "std_dev": f"sqrt(var_samp({column}))",
        "median": f"quantile_cont({column}, 0.5)",
        '"min"': f"min({column})",
        '"max"': f"max({column})",
        '"sum"': sql_sum(column),
    }
    cells = ", ".join(f"{sql_round2(e)} AS {n}" for n, e in parts.items())
    return f"SELECT '{column}' AS \"column\", 'Numerical' AS type, {cells}, count({column}) AS \"count\" FROM {table_name}"


@query("column_summary", f"WITH {MESSY} " + " UNION ALL ".join(
    [sql_summary("messy", c, c != "status") for c in ("status", *GAPPY)]))
def column_summary(spark, sf):
    return profile.column_summary(encode.drop_matching(messy(spark, sf), ["orderkey", "date"]))


@query("null_table", f"WITH {MESSY} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count(*) AS n_rows, count(*) - count({c}) AS n_missing FROM messy"
    for c, t in (("status", "string"), *((c, "double") for c in GAPPY))))
def null_table(spark, sf):
    return profile.null_counts(messy(spark, sf).drop("o_orderkey"))


@query("group_missing_mean", f"""WITH {MESSY}, m AS (SELECT status, CAST({MISSING} AS DOUBLE) AS k FROM messy)
  SELECT status, {sql_avg("k")} AS average_missing_count FROM m GROUP BY status""")
def group_missing_mean(spark, sf):
    counted = encode.add_missing_count(messy(spark, sf), columns=GAPPY)
    return profile.group_mean(counted, ["status"], "missing_count", "average_missing_count")


@query("category_percent", f"""WITH d AS (SELECT l.*, d.lang, d.source, d.n_chars, CASE WHEN d.doc_id % 4 < 3 THEN d.doc_id % 4 END AS ins
    FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
  t AS (SELECT 'good' AS category, * FROM d WHERE quality = 1 UNION ALL SELECT 'bad', * FROM d WHERE quality = 0
    UNION ALL SELECT 'toxic', * FROM d WHERE toxic = 1 UNION ALL SELECT 'long', * FROM d WHERE n_chars > 9000),
  u AS (SELECT category, CAST(ins AS VARCHAR) AS by_value, unnest(['lang', 'source']) AS group_col, unnest([lang, source]) AS group_value
    FROM t WHERE ins IS NOT NULL),
  combos AS (SELECT DISTINCT category, group_col, group_value FROM u),
  ins AS (SELECT DISTINCT CAST(ins AS VARCHAR) AS by_value FROM d WHERE ins IS NOT NULL),
  n AS (SELECT category, by_value, group_col, group_value, count(*) AS n FROM u GROUP BY ALL),
  f AS (SELECT c.category, i.by_value, c.group_col, c.group_value, coalesce(n.n, 0) AS n FROM combos c CROSS JOIN ins i
    LEFT JOIN n ON n.category = c.category AND n.by_value = i.by_value AND n.group_col = c.group_col AND n.group_value = c.group_value)
  SELECT *, {sql_round2("coalesce(100.0e0 * n / nullif(sum(n) OVER (PARTITION BY category, by_value, group_col), 0), 0.0e0)")} AS percent FROM f""")
def category_percent(spark, sf):
    d = labelled_docs(spark, sf).withColumn("ins", F.when(F.col("doc_id") % 4 < 3, F.col("doc_id") % 4))
    categories = {
        "good": F.col("quality") == 1, "bad": F.col("quality") == 0,
        "toxic": F.col("toxic") == 1, "long": F.col("n_chars") > 9000,
    }
    return profile.category_percent(d, categories, "ins", ["lang", "source"])


def labelled_docs(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return encode.attach_by_key(table(spark, sf, "labels"), docs, ["doc_id"], ["lang", "source", "n_chars"])


LABELLED = "d AS (SELECT l.doc_id, l.quality, l.toxic, d.lang, d.source, d.n_chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


@query("group_rates", f"""WITH {LABELLED}, u AS (SELECT quality, toxic, unnest(['lang', 'source']) AS group_col,
    unnest([lang, source]) AS group_value FROM d)
  SELECT group_col, group_value, count(*) AS n, 1.0e0 - {sql_avg("CAST(quality AS DOUBLE)")} AS survival_quality,
    1.0e0 - {sql_avg("CAST(toxic AS DOUBLE)")} AS survival_toxic FROM u GROUP BY group_col, group_value""")
def group_rates(spark, sf):
    return profile.rates_by_group(labelled_docs(spark, sf), ["quality", "toxic"], ["lang", "source"])


IQR = """q AS (SELECT quantile_cont(price, 0.25) AS p1, quantile_cont(price, 0.75) AS p3, quantile_cont(spread, 0.25) AS s1,
    quantile_cont(spread, 0.75) AS s3 FROM x WHERE o_orderkey % 5 <> 0)"""


@query("iqr_mask", f"""WITH {MESSY}, x AS (SELECT o_orderkey, price, price * price / 1000000.0e0 AS spread FROM messy), {IQR}
  SELECT o_orderkey, CASE WHEN price BETWEEN p1 - 1.5e0 * (p3 - p1) AND p3 + 1.5e0 * (p3 - p1) THEN price END AS price,
    CASE WHEN spread BETWEEN s1 - 1.5e0 * (s3 - s1) AND s3 + 1.5e0 * (s3 - s1) THEN spread END AS spread FROM x, q""")
def iqr_mask(spark, sf):
    x = messy(spark, sf).select("o_orderkey", "price", (F.col("price") * F.col("price") / 1000000.0).alias("spread"))
    limits = outliers.fit_iqr(x.where(F.col("o_orderkey") % 5 != 0), ["price", "spread"])
    return outliers.mask_outliers(x, limits)


@query("quantiles_ranked", """SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS q2,
    quantile_cont(o_totalprice, 0.9) AS q3 FROM orders""")
def quantiles_ranked(spark, sf):
    """The path for columns with too many distinct values for one aggregate."""
    q = ordered.exact_quantiles(table(spark, sf, "orders"), ["o_totalprice"], [0.25, 0.5, 0.9])
    return spark.createDataFrame([tuple(q["o_totalprice"])], "q1 double, q2 double, q3 double")


@query("histogram", """WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
  b AS (SELECT o_orderstatus, least(CAST(floor((o_totalprice - lo) / (hi - lo) * 20) AS BIGINT), 19) AS bin FROM orders, e),
  g AS (SELECT s.o_orderstatus, CAST(r AS BIGINT) AS bin FROM (SELECT DISTINCT o_orderstatus FROM orders) s, range(20) t(r)),
  c AS (SELECT o_orderstatus, bin, count(*) AS n FROM b GROUP BY ALL),
  f AS (SELECT g.o_orderstatus, g.bin, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.o_orderstatus) AS total
    FROM g LEFT JOIN c ON g.o_orderstatus = c.o_orderstatus AND g.bin = c.bin)
  SELECT o_orderstatus, CAST(bin AS INTEGER) AS bin, lo + bin * ((hi - lo) / 20) AS left_edge, n,
    n / (total * ((hi - lo) / 20)) AS density FROM f, e""")
def histogram(spark, sf):
    return profile.histogram(table(spark, sf, "orders"), "o_totalprice", 20, ["o_orderstatus"])


@query("boxplot", f"""WITH {MESSY}, x AS (SELECT unnest(['price', 'age', 'cube']) AS "column",
    unnest([price, age, steps * steps * steps]) AS v FROM messy),
  q AS (SELECT "column", quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM x GROUP BY ALL)
  SELECT q."column", q1, median, q3, min(CASE WHEN v >= q1 - 1.5e0 * (q3 - q1) THEN v END) AS whisker_low,
    max(CASE WHEN v <= q3 + 1.5e0 * (q3 - q1) THEN v END) AS whisker_high,
    count(CASE WHEN v < q1 - 1.5e0 * (q3 - q1) OR v > q3 + 1.5e0 * (q3 - q1) THEN 1 END) AS n_outliers
  FROM x JOIN q ON x."column" = q."column" GROUP BY q."column", q1, median, q3""")
def boxplot(spark, sf):
    s = F.col("steps")
    return profile.boxplot_stats(messy(spark, sf).withColumn("cube", s * s * s), ["price", "age", "cube"])


@query("kde_grid", """WITH s AS (SELECT event_type, count(*) AS n, stddev_samp(value) * pow(count(*), -0.2e0) AS h, min(value) AS lo,
    max(value) AS hi FROM events GROUP BY event_type),
  g AS (SELECT s.*, CAST(r AS INTEGER) AS point, (lo - 3 * h) + ((hi + 3 * h) - (lo - 3 * h)) * r / 49.0e0 AS x FROM s, range(50) t(r))
  SELECT g.event_type, g.point, round(g.x, 6) AS x,
    round(sum(exp(-0.5e0 * ((g.x - e.value) / h) * ((g.x - e.value) / h)) / (n * h * sqrt(2 * pi()))), 9) AS density
  FROM g JOIN events e ON e.event_type = g.event_type GROUP BY g.event_type, g.point, g.x""")
def kde_grid(spark, sf):
    out = profile.kde_grid(table(spark, sf, "events"), "value", ["event_type"], points=50)
    return out.select("event_type", "point", F.round("x", 6).alias("x"), F.round("density", 9).alias("density"))


@query("density_grid", """WITH s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS sd, min(o_totalprice) AS lo,
    max(o_totalprice) AS hi FROM orders), g AS (SELECT r AS point, lo + (hi - lo) * r / 999.0e0 AS x, m, sd FROM s, range(1000) t(r))
  SELECT point, round(x, 4) AS x, round(1e6 * exp(-((x - m) / sd) * ((x - m) / sd) / 2) / (sd * sqrt(2 * pi())), 8) AS density FROM g""")
def density_grid(spark, sf):
    o = table(spark, sf, "orders")
    m, sd = dist.fit_standard(o, ["o_totalprice"])["o_totalprice"]
    grid = dist.density_grid(spark, o, "o_totalprice", dist.Fit("norm", (), m, sd, 0.0, 1.0))
    return grid.select("point", F.round("x", 4).alias("x"), F.round(F.col("density") * 1e6, 8).alias("density"))


@query("strat_split", """WITH x AS (SELECT *, (doc_id * 7919) % 10007 AS o FROM labels),
  c AS (SELECT quality, count(*) AS c, ceil(round(0.2e0 * (SELECT count(*) FROM labels), 9)) AS w FROM labels GROUP BY quality),
  e AS (SELECT quality, c, w, w * c / (SELECT count(*) FROM labels) AS exact FROM c),
  k AS (SELECT *, floor(exact) AS base, row_number() OVER (ORDER BY floor(exact) - exact, CAST(quality AS VARCHAR)) AS turn,
    w - sum(floor(exact)) OVER () AS spare FROM e),
  r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY o, doc_id) AS rn FROM x)
  SELECT r.doc_id, r.quality, r.toxic, CASE WHEN rn <= base + CASE WHEN turn <= spare THEN 1 ELSE 0 END THEN 'test' ELSE 'train' END
    AS split FROM r JOIN k ON r.quality = k.quality""")
def strat_split(spark, sf):
    order = (F.col("doc_id") * 7919) % 10007
    return split.stratified_split(table(spark, sf, "labels"), "quality", "doc_id", order=order)


@query("hash_split", """WITH o AS (SELECT DISTINCT l_orderkey, CASE WHEN l_orderkey % 11 = 0 THEN 1 ELSE 0 END AS y FROM lineitem),
  c AS (SELECT y, count(*) AS m, sum(count(*)) OVER () AS n FROM o GROUP BY y), w AS (SELECT *, ceil(round(n * 0.2e0, 9)) AS wanted FROM c),
  q AS (SELECT *, floor(wanted * m / n) AS base, row_number() OVER (ORDER BY floor(wanted * m / n) - wanted * m / n, y) AS place FROM w),
  t AS (SELECT y, m, CAST(base + CASE WHEN place <= wanted - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS test FROM q)
  SELECT y, 'test' AS split, test AS n FROM t UNION ALL SELECT y, 'train', m - test FROM t""")
def hash_split(spark, sf):
    """Sizes of the parts of a stratified split."""
    keys = table(spark, sf, "lineitem").select("l_orderkey").distinct()
    parts = split.stratified_split(keys.withColumn("y", (F.col("l_orderkey") % 11 == 0).cast("int")), "y", "l_orderkey")
    return parts.groupBy("y", "split").agg(F.count("*").alias("n"))


@query("standardise", f"""WITH {MESSY}, s AS (SELECT avg(price) AS pm, stddev_pop(price) AS ps, avg(steps) AS sm, stddev_pop(steps) AS ss
    FROM messy WHERE o_orderkey % 5 <> 0)
  SELECT o_orderkey, round((price - pm) / ps, 6) AS price, round((steps - sm) / ss, 6) AS steps FROM messy, s""")
def standardise(spark, sf):
    x = messy(spark, sf).select("o_orderkey", "price", "steps")
    out = dist.standardise(x, dist.fit_standard(x.where(F.col("o_orderkey") % 5 != 0), ["price", "steps"]))
    return out.select("o_orderkey", F.round("price", 6).alias("price"), F.round("steps", 6).alias("steps"))


@query("rank_normal", f"""WITH {MESSY}, r AS (SELECT age, rank() OVER (ORDER BY age) AS r, count(*) OVER (PARTITION BY age) AS k,
    count(*) OVER () AS n FROM messy WHERE age IS NOT NULL)
  SELECT DISTINCT age, r + (k - 1) / 2.0e0 AS avg_rank, n, (r + (k - 1) / 2.0e0) / (n + 1) AS p FROM r""")
def rank_normal(spark, sf):
    ranks = ordered.average_ranks(messy(spark, sf), "age")
    return ranks.withColumn("p", F.col("avg_rank") / (F.col("n") + 1))


def sql_rank(c: str) -> str:
    train = f"CASE WHEN o_orderkey % 5 <> 0 AND {c} IS NOT NULL THEN 1 ELSE 0 END"
    share = f"""(sum({train}) OVER (ORDER BY {c}) - sum({train}) OVER (PARTITION BY {c}) + (sum({train}) OVER (PARTITION BY {c}) + 1) / 2.0e0)
      / (sum({train}) OVER () + 1)"""
    return f"CASE WHEN {c} IS NOT NULL THEN round(least(greatest({share}, 0.000001e0), 0.999999e0), 9) END AS {c}"


@query("rank_scores", f"WITH {MESSY} SELECT o_orderkey, {sql_rank('price')}, {sql_rank('age')} FROM messy")
def rank_scores(spark, sf):
    """Normal scores of ranks among the training rows, mapped back to shares."""
    x = messy(spark, sf).select("o_orderkey", "price", "age")
    out = dist.normal_scores(x, {"price": None, "age": None}, F.col("o_orderkey") % 5 != 0)
    return out.select("o_orderkey", *[F.round(normal_cdf_column(c), 9).alias(c) for c in ("price", "age")])


@query("ecdf", """SELECT DISTINCT l_quantity, (rank() OVER (ORDER BY l_quantity) - 1) / CAST(count(*) OVER () AS DOUBLE) AS ecdf_below,
    cume_dist() OVER (ORDER BY l_quantity) AS ecdf, count(*) OVER () AS n FROM lineitem""")
def ecdf(spark, sf):
    return ordered.ecdf(table(spark, sf, "lineitem"), "l_quantity")


@query("co_missing", f"""WITH {MESSY}, u AS (""" + " UNION ALL ".join(
    f"SELECT '{a}' AS col_i, '{b}' AS col_j, count(CASE WHEN {a} IS NULL AND {b} IS NOT NULL THEN 1 END) AS n FROM messy"
    for a in GAPPY[:4] for b in GAPPY[:4]) + ") SELECT * FROM u")
def co_missing(spark, sf):
    return missing.missing_present_table(messy(spark, sf), GAPPY)


@query("co_missing_chi2", f"""WITH {MESSY}, u AS (""" + " UNION ALL ".join(
    f"SELECT '{a}' AS i, '{b}' AS j, CAST(count(CASE WHEN {a} IS NULL AND {b} IS NOT NULL THEN 1 END) AS DOUBLE) AS n FROM messy"
    for a in GAPPY[:4] for b in GAPPY[:4]) + """), x AS (SELECT *, sum(n) OVER (PARTITION BY i) * sum(n) OVER (PARTITION BY j) / sum(n) OVER () AS e FROM u)
  SELECT round(sum((n - e) * (n - e) / e), 6) AS statistic, 9 AS dof FROM x""")
def co_missing_chi2(spark, sf):
    found = missing.co_missing_chi2(messy(spark, sf), GAPPY)
    return spark.createDataFrame([(round(found["statistic"], 6), found["dof"])], "statistic double, dof int")


@query("co_missing_groups", f"""WITH {MESSY}, u AS (""" + " UNION ALL ".join(
    f"SELECT status, '{a}' AS i, '{b}' AS j, CAST(count(CASE WHEN {a} IS NULL AND {b} IS NOT NULL THEN 1 END) AS DOUBLE) AS n FROM messy GROUP BY status"
    for a in GAPPY[:4] for b in GAPPY[:4]) + """), x AS (SELECT *, sum(n) OVER (PARTITION BY status, i) AS a, sum(n) OVER (PARTITION BY status, j) AS b,
    sum(n) OVER (PARTITION BY status) AS t FROM u)
  SELECT status AS "group", round(sum((n - a * b / t) * (n - a * b / t) / (a * b / t)), 6) AS statistic,
    CAST((count(DISTINCT i) - 1) * (count(DISTINCT j) - 1) AS INTEGER) AS dof FROM x WHERE a > 0 AND b > 0 GROUP BY status""")
def co_missing_groups(spark, sf):
    groups = {s: F.col("status") == s for s in encode.category_names(messy(spark, sf), "status", 50)}
    found = missing.co_missing_by_group(messy(spark, sf), GAPPY, groups)
    return found.select("group", F.round("statistic", 6).alias("statistic"), "dof")


@query("nullity_corr", f"""WITH {MESSY}, m AS (SELECT """ + ", ".join(
    f"CASE WHEN {c} IS NULL THEN 1.0e0 ELSE 0.0e0 END AS {c}" for c in GAPPY[:4]) + " FROM messy) " + " UNION ALL ".join(
    f"SELECT '{a}' AS col_i, '{b}' AS col_j, round(corr({a}, {b}), 9) AS corr FROM m"
    for i, a in enumerate(sorted(GAPPY[:4])) for b in sorted(GAPPY[:4])[i + 1 :]))
def nullity_corr(spark, sf):
    found = missing.nullity_correlation(messy(spark, sf), GAPPY)
    return found.withColumn("corr", F.round("corr", 9))


@query("missing_predict_auc")
def missing_predict_auc(spark, sf):
    """All orders, and the orders of every status on their own."""
    groups = {"all": F.lit(True), **{name: F.col("status") == code for name, code in (("open", "O"), ("filled", "F"), ("partial", "P"))}}
    return missing.missing_predictability(messy(spark, sf), GAPPY, groups=groups)


@query("distinct_values", """SELECT 'lang' AS name, lang AS value FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)
  UNION ALL SELECT 'source', source FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)""")
def distinct_values(spark, sf):
    docs = table(spark, sf, "documents")
    found = [(c, encode.distinct_values(docs, c)) for c in ("lang", "source")]
    return io.union_all([v.select(F.lit(c).alias("name"), F.col(c).alias("value")) for c, v in found])


@query("key_concat", f"""WITH {LABELLED} SELECT doc_id, quality, toxic, lang, n_chars,
    CASE WHEN (doc_id * 7919) % 10007 < 2000 THEN 'test' ELSE 'train' END AS split FROM d""")
def key_concat(spark, sf):
    marked = table(spark, sf, "labels").withColumn(
        "split", F.when((F.col("doc_id") * 7919) % 10007 < 2000, "test").otherwise("train")
    )
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return encode.attach_by_key(marked, docs, ["doc_id"], ["lang", "n_chars"])


@query("select_drop", """SELECT o_orderkey, o_custkey, 99.5e0 AS o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_custkey > 10""")
def select_drop(spark, sf):
    o = table(spark, sf, "orders").where((F.col("o_orderstatus") == "O") & (F.col("o_custkey") > 10))
    kept = encode.drop_matching(o, ["date", "priority"])
    return encode.override(kept.select(*encode.numeric_columns(kept)), "o_totalprice", 99.5)


# score and prediction by rule from the text length
SCORED = LABELLED + """, s AS (SELECT *, CAST(n_chars % 1000 AS DOUBLE) / 1000.0e0 AS p,
    CASE WHEN n_chars % 1000 >= 400 THEN 1 ELSE 0 END AS pred FROM d)"""


def scored(spark, sf):
    x = F.col("n_chars") % 1000
    return labelled_docs(spark, sf).withColumns(
        {"p": x.cast("double") / 1000.0, "pred": F.when(x >= 400, 1).otherwise(0)}
    )


COUNTS = """count(CASE WHEN quality = 1 AND pred = 1 THEN 1 END) AS tp, count(CASE WHEN quality = 0 AND pred = 1 THEN 1 END) AS fp,
    count(CASE WHEN quality = 1 AND pred = 0 THEN 1 END) AS fn, count(CASE WHEN quality = 0 AND pred = 0 THEN 1 END) AS tn"""
RATES = """coalesce(CAST(tp + tn AS DOUBLE) / nullif(tp + fp + fn + tn, 0), 0.0e0) AS accuracy,
    coalesce((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn)
      / nullif(sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0.0e0) AS mcc,
    coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0.0e0) AS f1_score,
    coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0e0) AS sensitivity,
    coalesce(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 0.0e0) AS specificity,
    coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0e0) AS ppv,
    coalesce(CAST(tn AS DOUBLE) / nullif(tn + fn, 0), 0.0e0) AS npv"""
AUC = """(sum(CASE WHEN quality = 1 THEN r END) - CAST(count(CASE WHEN quality = 1 THEN 1 END) AS DOUBLE)
    * (count(CASE WHEN quality = 1 THEN 1 END) + 1) / 2.0e0)
    / (CAST(count(CASE WHEN quality = 1 THEN 1 END) AS DOUBLE) * count(CASE WHEN quality = 0 THEN 1 END))"""


@query("confusion_metrics", f"WITH {SCORED}, c AS (SELECT toxic, {COUNTS} FROM s GROUP BY toxic) SELECT *, {RATES} FROM c")
def confusion_metrics(spark, sf):
    return metrics.confusion_metrics(scored(spark, sf), "quality", "pred", ["toxic"])


@query("auc_rank", f"""WITH {SCORED}, r AS (SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1)
    / 2.0e0 AS r FROM s) SELECT {AUC} AS auc FROM r""")
def auc_rank(spark, sf):
    return metrics.auc(scored(spark, sf), "quality", "n_chars")


@query("roc_points", f"""WITH {SCORED}, t AS (SELECT DISTINCT p AS threshold FROM s)
  SELECT threshold, (SELECT CAST(count(*) AS DOUBLE) FROM s WHERE quality = 0 AND p >= threshold) / (SELECT count(*) FROM s WHERE quality = 0) AS fpr,
    (SELECT CAST(count(*) AS DOUBLE) FROM s WHERE quality = 1 AND p >= threshold) / (SELECT count(*) FROM s WHERE quality = 1) AS tpr FROM t""")
def roc_points(spark, sf):
    return metrics.roc_points(scored(spark, sf), "quality", "p")


@query("class_report", f"""WITH {SCORED}, c AS (SELECT {COUNTS} FROM s), x AS (SELECT *, CAST(tn + fp AS DOUBLE) AS s0, CAST(tp + fn AS DOUBLE) AS s1,
    coalesce(CAST(tn AS DOUBLE) / nullif(tn + fn, 0), 0) AS p0, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS p1,
    coalesce(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 0) AS r0, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS r1,
    coalesce(CAST(2 * tn AS DOUBLE) / nullif(2 * tn + fp + fn, 0), 0) AS f0, coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0) AS f1,
    CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn) AS acc FROM c)
  SELECT '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1_score, CAST(s0 AS BIGINT) AS support FROM x
  UNION ALL SELECT '1', p1, r1, f1, CAST(s1 AS BIGINT) FROM x
  UNION ALL SELECT 'accuracy', acc, acc, acc, CAST(s0 + s1 AS BIGINT) FROM x
  UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, CAST(s0 + s1 AS BIGINT) FROM x
  UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / (s0 + s1), (r0 * s0 + r1 * s1) / (s0 + s1),
    (f0 * s0 + f1 * s1) / (s0 + s1), CAST(s0 + s1 AS BIGINT) FROM x""")
def class_report(spark, sf):
    return metrics.class_report(scored(spark, sf), "quality", "pred")


@query("group_metrics", f"""WITH {SCORED}, u AS (SELECT quality, pred, p, unnest(['lang', 'source']) AS group_col,
    unnest([lang, source]) AS group_value FROM s),
  r AS (SELECT *, rank() OVER (PARTITION BY group_col, group_value ORDER BY p)
    + (count(*) OVER (PARTITION BY group_col, group_value, p) - 1) / 2.0e0 AS r FROM u),
  c AS (SELECT group_col, group_value, {COUNTS} FROM r GROUP BY group_col, group_value),
  a AS (SELECT group_col, group_value, {AUC} AS auc FROM r GROUP BY group_col, group_value
    HAVING count(CASE WHEN quality = 1 THEN 1 END) > 0 AND count(CASE WHEN quality = 0 THEN 1 END) > 0),
  m AS (SELECT group_col, group_value, tp + fp + fn + tn AS n, tp, fp, fn, tn, {RATES} FROM c WHERE tp + fn > 0 AND fp + tn > 0)
  SELECT m.group_col, m.group_value, n, tp, fp, fn, tn, accuracy, mcc, f1_score, (sensitivity + specificity) / 2.0e0 AS auc_hard, auc
  FROM m JOIN a ON m.group_col = a.group_col AND m.group_value = a.group_value""")
def group_metrics(spark, sf):
    return metrics.group_metrics(scored(spark, sf), "quality", "pred", "p", ["lang", "source"])


@query("normal_cdf_ppf", """SELECT l_orderkey, l_linenumber, (l_partkey % 999 + 1) / 1000.0e0 AS p,
    round((l_partkey % 999 + 1) / 1000.0e0, 9) AS back FROM lineitem""")
def normal_cdf_ppf(spark, sf):
    """The distribution function of the quantile is the probability again."""
    p = (F.col("l_partkey") % 999 + 1) / 1000.0
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", p.alias("p"))
    return li.withColumn("back", F.round(normal_cdf_column(normal_quantile_column("p")), 9))


@query("dist_fit")
def dist_fit(spark, sf):
    """Best family per measure of the line items."""
    x = table(spark, sf, "lineitem").select("l_extendedprice", "l_quantity", (F.col("l_quantity") * F.col("l_discount")).alias("mixed"))
    return dist.fits_frame(spark, dist.best_fits(x, x.columns))


@query("ecdf_ks", """WITH m AS (SELECT count(*) AS n, min(o_totalprice) AS lo, avg(o_totalprice) AS mean,
    stddev_pop(o_totalprice) * sqrt(2 / (4 - pi())) AS s FROM orders),
  f AS (SELECT 'expon' AS family, lo AS loc, mean - lo AS scale, n FROM m UNION ALL SELECT 'rayleigh', mean - s * sqrt(pi() / 2), s, n FROM m),
  v AS (SELECT x, sum(c) OVER (ORDER BY x) AS upto, c FROM (SELECT o_totalprice AS x, count(*) AS c FROM orders GROUP BY 1)),
  p AS (SELECT f.*, upto, c, CASE WHEN x <= loc THEN 0.0e0 WHEN family = 'expon' THEN 1 - exp(-(x - loc) / scale)
    ELSE 1 - exp(-((x - loc) / scale) * ((x - loc) / scale) / 2) END AS cdf FROM f, v)
  SELECT 'o_totalprice' AS "column", family, round(loc, 5) AS loc, round(scale, 5) AS scale, n,
    round(max(greatest(cdf - (upto - c) / n, upto / n - cdf)), 9) AS ks_stat FROM p GROUP BY family, loc, scale, n""")
def ecdf_ks(spark, sf):
    """Distance of order totals to two fitted families whose distribution functions are elementary."""
    out = dist.fit_table(table(spark, sf, "orders"), ["o_totalprice"], ["expon", "rayleigh"])
    return out.select("column", "family", F.round("loc", 5).alias("loc"), F.round("scale", 5).alias("scale"), "n", F.round("ks_stat", 9).alias("ks_stat"))


def sql_normal(z: str) -> str:
    """Normal distribution function by its power series."""
    term = f"exp((2 * k + 1) * ln(abs({z}) + 1e-300) - (k + 1) * ln(2.0e0) - lgamma(k + 1.5e0) + 0.5e0 * ln(pi()))"
    return f"0.5e0 + sign({z}) * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 120), lambda k: {term}))"


# family: shapes, location, scale, and its distribution function and density of z = (x - location) / scale in SQL
FAMILIES = {
    "norm": ((), 1.0, 2.0, sql_normal("z"), "exp(-z * z / 2) / sqrt(2 * pi())"),
    "lognorm": ((0.5,), 0.0, 1.5, sql_normal("(ln(z) / 0.5e0)"), "exp(-2 * ln(z) * ln(z)) / (z * 0.5e0 * sqrt(2 * pi()))"),
    "gamma": ((3.0,), 0.0, 0.5, "1 - exp(-z) * (1 + z + z * z / 2)", "exp(2 * ln(z) - z - lgamma(3.0e0))"),
    "beta": ((2.0, 3.0), 0.0, 6.0, "z * z * (6 - 8 * z + 3 * z * z)", "z * (1 - z) * (1 - z) * exp(lgamma(5.0e0) - lgamma(2.0e0) - lgamma(3.0e0))"),
    "weibull_min": ((1.7,), 0.0, 1.2, "1 - exp(-pow(z, 1.7e0))", "1.7e0 * pow(z, 0.7e0) * exp(-pow(z, 1.7e0))"),
    "expon": ((), -0.1, 1.0, "1 - exp(-z)", "exp(-z)"),
    "rayleigh": ((), 0.0, 1.3, "1 - exp(-z * z / 2)", "z * exp(-z * z / 2)"),
    "t": ((4.0,), 1.0, 0.7, "0.5e0 + 0.375e0 * z / sqrt(1 + z * z / 4) * (1 - z * z / (12 * (1 + z * z / 4)))", "0.375e0 * pow(1 + z * z / 4, -2.5e0)"),
}


def sql_families(part: int) -> str:
    return " UNION ALL ".join(
        f"SELECT '{f}' AS family, key, x, {v[part]} AS v, {v[2]!r}e0 AS scale FROM (SELECT key, x, (x - {v[1]!r}e0) / {v[2]!r}e0 AS z FROM points)" for f, v in FAMILIES.items()
    )


@query("cdf_families", f"""WITH points AS (SELECT o_orderkey AS key, o_totalprice / 100000.0e0 AS x FROM orders), f AS ({sql_families(3)})
  SELECT family, key AS o_orderkey, round(v, 9) AS cdf FROM f""")
def cdf_families(spark, sf):
    """All eight distribution functions at the order totals."""
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 100000.0).alias("x"))
    rows = [(f, list(shapes), loc, scale) for f, (shapes, loc, scale, *_) in FAMILIES.items()]
    fits = F.array(*[F.struct(F.lit(f).alias("family"), F.array(*[F.lit(v) for v in sh]).cast("array<double>").alias("shapes"), F.lit(loc).alias("loc"), F.lit(scale).alias("scale")) for f, sh, loc, scale in rows])
    each = o.select("o_orderkey", "x", F.inline(fits))
    return each.select("family", "o_orderkey", F.round(cdf_column("family", "family", "shapes", "loc", "scale", "x"), 9).alias("cdf"))


@query("density_families", f"""WITH s AS (SELECT min(o_totalprice) / 100000.0e0 AS lo, max(o_totalprice) / 100000.0e0 AS hi FROM orders),
  points AS (SELECT CAST(r AS BIGINT) AS key, lo + (hi - lo) * r / 199.0e0 AS x FROM s, range(200) t(r)), f AS ({sql_families(4)})
  SELECT family, key AS point, round(x, 6) AS x, round(v / scale, 9) AS density FROM f""")
def density_families(spark, sf):
    """All eight densities over the range of the order totals."""
    o = table(spark, sf, "orders").select((F.col("o_totalprice") / 100000.0).alias("x"))
    grids = [
        dist.density_grid(spark, o, "x", dist.Fit(f, shapes, loc, scale, 0.0, 1.0), 200).select(
            F.lit(f).alias("family"), "point", F.round("x", 6).alias("x"), F.round("density", 9).alias("density")
        )
        for f, (shapes, loc, scale, *_) in FAMILIES.items()
    ]
    return reduce(DataFrame.unionByName, grids)


@query("fits_roundtrip", """WITH u AS (SELECT 'l_quantity' AS "column", CAST(l_quantity AS DOUBLE) AS x FROM lineitem
    UNION ALL SELECT 'l_extendedprice', CAST(l_extendedprice AS DOUBLE) FROM lineitem UNION ALL SELECT 'l_discount', CAST(l_discount AS DOUBLE) FROM lineitem),
  m AS (SELECT "column", count(*) AS n, min(x) AS lo, avg(x) AS mean, stddev_pop(x) * sqrt(2 / (4 - pi())) AS s FROM u GROUP BY 1),
  f AS (SELECT "column", n, 'expon' AS family, lo AS loc, mean - lo AS scale FROM m UNION ALL SELECT "column", n, 'rayleigh', mean - s * sqrt(pi() / 2), s FROM m),
  v AS (SELECT "column", x, c, sum(c) OVER (PARTITION BY "column" ORDER BY x) AS upto FROM (SELECT "column", x, count(*) AS c FROM u GROUP BY 1, 2)),
  p AS (SELECT f.*, upto, c, CASE WHEN x <= loc THEN 0.0e0 WHEN family = 'expon' THEN 1 - exp(-(x - loc) / scale)
    ELSE 1 - exp(-((x - loc) / scale) * ((x - loc) / scale) / 2) END AS cdf FROM f JOIN v ON f."column" = v."column"),
  d AS (SELECT "column", family, loc, scale, max(greatest(cdf - (upto - c) / n, upto / n - cdf)) AS ks FROM p GROUP BY ALL)
  SELECT "column", family, round(loc, 5) AS loc, round(scale, 5) AS scale, round(ks, 9) AS ks FROM d
  QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY ks) = 1""")
def fits_roundtrip(spark, sf):
    """Best fits, written as JSON lines and read back."""
    li = table(spark, sf, "lineitem")
    path = shared_dir(spark)
    store.write_fits(spark, dist.best_fits(li, ["l_quantity", "l_extendedprice", "l_discount"], ["expon", "rayleigh"]), path)
    again = store.fits_table(spark, store.read_fits(spark, path))
    return again.select("column", "family", *[F.round(c, d).alias(c) for c, d in (("loc", 5), ("scale", 5), ("ks", 9))])


@query("ks_families", f"""WITH RECURSIVE d AS (SELECT o_totalprice / 1000.0e0 AS x FROM orders),
  m AS (SELECT count(*) AS n, min(x) AS lo, max(x) AS hi, avg(x) AS mean, stddev_pop(x) AS sd, avg(ln(x)) AS lm, stddev_pop(ln(x)) AS ls FROM d),
  w AS (SELECT 0 AS k, pi() / (ls * sqrt(6)) AS c FROM m
    UNION ALL SELECT k + 1, c - (sum(z * exp(c * z)) / sum(exp(c * z)) - 1 / c - avg(z)) / (sum(z * z * exp(c * z)) / sum(exp(c * z))
      - pow(sum(z * exp(c * z)) / sum(exp(c * z)), 2) + 1 / (c * c)) FROM w, (SELECT ln(x / hi) AS z FROM d, m) WHERE k < 30 GROUP BY k, c),
  c AS (SELECT c FROM w WHERE k = 30), b AS (SELECT c, pow(avg(pow(x, c)), 1 / c) AS scale FROM d, c GROUP BY c),
  f AS (SELECT 'norm' AS family, CAST(NULL AS DOUBLE) AS shape, mean AS loc, sd AS scale FROM m
    UNION ALL SELECT 'lognorm', ls, 0.0e0, exp(lm) FROM m UNION ALL SELECT 'expon', NULL, lo, mean - lo FROM m
    UNION ALL SELECT 'weibull_min', c, 0.0e0, scale FROM b),
  v AS (SELECT x, sum(c) OVER (ORDER BY x) AS upto, c FROM (SELECT x, count(*) AS c FROM d GROUP BY 1)),
  p AS (SELECT f.*, upto, v.c, n, CASE family WHEN 'expon' THEN 1 - exp(-(x - loc) / scale) WHEN 'weibull_min' THEN 1 - exp(-pow(x / scale, shape))
    WHEN 'norm' THEN {sql_normal("((x - loc) / scale)")} ELSE {sql_normal("(ln(x / scale) / shape)")} END AS cdf FROM f, v, m)
  SELECT family, round(shape, 6) AS shape, round(loc, 5) AS loc, round(scale, 5) AS scale, n,
    round(max(greatest(cdf - (upto - c) / n, upto / n - cdf)), 9) AS ks_stat FROM p GROUP BY family, shape, loc, scale, n""")
def ks_families(spark, sf):
    """Likelihood fits, one of them by steps over all rows, and their distances."""
    o = table(spark, sf, "orders").select((F.col("o_totalprice") / 1000.0).alias("x"))
    out = dist.fit_table(o, ["x"], ["norm", "lognorm", "expon", "weibull_min"])
    return out.select("family", F.round(F.get("shapes", F.lit(0)), 6).alias("shape"), F.round("loc", 5).alias("loc"), F.round("scale", 5).alias("scale"), "n", F.round("ks_stat", 9).alias("ks_stat"))


@query("init_pipeline", f"""WITH c AS (SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal / 2 END AS half,
    CASE WHEN c_custkey % 4 <> 0 THEN c_nationkey END AS nation_no, CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS nm, c_mktsegment FROM customer),
  e AS (SELECT *, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 0 END AS segment,
    CASE WHEN nm IS NULL THEN 0 WHEN upper(nm) LIKE '%7%' THEN 1 WHEN upper(nm) LIKE '%8%' THEN 2 ELSE 0 END AS kind FROM c),
  m AS (SELECT c_custkey, c_acctbal, half, nation_no, segment, kind, CASE WHEN half IS NULL THEN 1 ELSE 0 END
    + CASE WHEN nation_no IS NULL THEN 1 ELSE 0 END + CASE WHEN segment IS NULL THEN 1 ELSE 0 END AS missing_count FROM e)
  SELECT * FROM m WHERE missing_count <= 1""")
def init_pipeline(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    raw = c.select(
        "c_custkey", "c_acctbal", F.when(k % 3 != 0, F.col("c_acctbal") / 2).alias("half"),
        F.when(k % 4 != 0, F.col("c_nationkey")).alias("nation_no"), F.when(k % 5 != 0, F.col("c_name")).alias("nm"), "c_mktsegment",
    )
    encodings = {
        "segment": encode.map_values(F.col("c_mktsegment"), {"BUILDING": 1, "MACHINERY": 0}),
        "kind": encode.map_contains(F.col("nm"), [(("7",), 1), (("8",), 2)], F.lit(0)),
    }
    features = ["c_acctbal", "half", "nation_no", "segment", "kind"]
    return analysis.prepare(raw, ["nm", "c_mktsegment"], encodings, [features], 0.8)

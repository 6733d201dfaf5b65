"""Imputation, models, search, contributions, counterfactuals."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.profile_queries import LABELLED, labelled_docs
from checks.registry import query, table
from cohortflow.functions.numeric import round_half_away
from cohortflow.operators import encode, explain, fairness, impute, metrics, models, outliers
from cohortflow.operators.split import stratified_split
from cohortflow.plans import analysis, store
from cohortflow.session import settle, shared_dir
from cohortflow.sources import io

GAPS = """g AS (SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size AS DOUBLE) END AS size,
    CASE WHEN p_partkey % 7 <> 1 THEN p_retailprice END AS price, CAST((p_partkey * 37) % 101 AS DOUBLE) AS weight,
    CASE WHEN p_partkey % 3 <> 2 THEN CAST((p_partkey * 53) % 17 AS DOUBLE) END AS grade FROM part)"""
COLS = ("size", "price", "weight", "grade")


def gaps(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        "p_partkey",
        F.when(k % 5 != 0, F.col("p_size").cast("double")).alias("size"),
        F.when(k % 7 != 1, F.col("p_retailprice")).alias("price"),
        ((k * 37) % 101).cast("double").alias("weight"),
        F.when(k % 3 != 2, ((k * 53) % 17).cast("double")).alias("grade"),
    )


def sql_square(c: str) -> str:
    return f"CASE WHEN a.{c} IS NOT NULL AND b.{c} IS NOT NULL THEN (a.{c} - b.{c}) * (a.{c} - b.{c}) ELSE 0.0e0 END"


def sql_knn(k: int) -> str:
    total = " + ".join(sql_square(c) for c in COLS)
    shared = " + ".join(f"CASE WHEN a.{c} IS NOT NULL AND b.{c} IS NOT NULL THEN 1 ELSE 0 END" for c in COLS)
    fills = ", ".join(
        f"f_{c} AS (SELECT p_partkey, avg(v) AS m FROM (SELECT p_partkey, v, row_number() OVER (PARTITION BY p_partkey "
        f"ORDER BY sqrt(total * 4 / shared), CAST(donor AS VARCHAR)) AS rn FROM (SELECT p_partkey, donor, total, shared, d_{c} AS v "
        f"FROM pairs WHERE q_{c} IS NULL AND d_{c} IS NOT NULL AND shared > 0)) WHERE rn <= {k} GROUP BY p_partkey)"
        for c in COLS if c != "weight"
    )
    sides = ", ".join(f"a.{c} AS q_{c}, b.{c} AS d_{c}" for c in COLS)
    joins = " ".join(f"LEFT JOIN f_{c} ON f_{c}.p_partkey = g.p_partkey" for c in COLS if c != "weight")
    out = ", ".join(f"round(coalesce(g.{c}, f_{c}.m), 6) AS {c}" if c != "weight" else "g.weight" for c in COLS)
    return f"""WITH {GAPS}, pairs AS (SELECT a.p_partkey, b.p_partkey AS donor, {total} AS total, {shared} AS shared, {sides}
      FROM g a, g b WHERE a.size IS NULL OR a.price IS NULL OR a.grade IS NULL), {fills}
    SELECT g.p_partkey, {out} FROM g {joins}"""


@query("knn_impute", sql_knn(5))
def knn_impute(spark, sf):
    x = gaps(spark, sf)
    filled = impute.KnnImputer(COLS, "p_partkey", k=5, block=512).fit(x).transform(x)
    return filled.select(
        "p_partkey", *[F.round(c, 6).alias(c) if c != "weight" else F.col(c) for c in COLS]
    )


def sql_fill(name: str, source: str, donors: str, k: int) -> str:
    """CTE ``name``: ``source`` with its gaps filled from the nearest rows of ``donors``, or their mean if none is near."""
    total = " + ".join(sql_square(c) for c in COLS)
    shared = " + ".join(f"CASE WHEN a.{c} IS NOT NULL AND b.{c} IS NOT NULL THEN 1 ELSE 0 END" for c in COLS)
    sides = ", ".join(f"a.{c} AS q_{c}, b.{c} AS d_{c}" for c in COLS)
    fills = ", ".join(
        f"{name}_{c} AS (SELECT p_partkey, avg(v) AS m FROM (SELECT p_partkey, d_{c} AS v, row_number() OVER (PARTITION BY p_partkey "
        f"ORDER BY sqrt(total * 4 / shared), CAST(donor AS VARCHAR)) AS rn FROM {name}_pairs WHERE q_{c} IS NULL AND d_{c} IS NOT NULL "
        f"AND shared > 0) WHERE rn <= {k} GROUP BY p_partkey)"
        for c in COLS
    )
    out = ", ".join(f"coalesce(s.{c}, {name}_{c}.m, (SELECT avg({c}) FROM {donors})) AS {c}" for c in COLS)
    joins = " ".join(f"LEFT JOIN {name}_{c} ON {name}_{c}.p_partkey = s.p_partkey" for c in COLS)
    gap = " OR ".join(f"a.{c} IS NULL" for c in COLS)
    return f"""{name}_pairs AS (SELECT a.p_partkey, b.p_partkey AS donor, {total} AS total, {shared} AS shared, {sides} FROM {source} a, {donors} b
      WHERE {gap}), {fills}, {name} AS (SELECT s.p_partkey, {out} FROM {source} s {joins})"""


def sql_chain(k: int) -> str:
    ends = ", ".join(f"quantile_cont({c}, 0.25) AS {c}1, quantile_cont({c}, 0.75) AS {c}3" for c in COLS)
    masked = ", ".join(f"CASE WHEN {c} BETWEEN {c}1 - 1.5e0 * ({c}3 - {c}1) AND {c}3 + 1.5e0 * ({c}3 - {c}1) THEN {c} END AS {c}" for c in COLS)
    return f"""WITH {GAPS}, far AS (SELECT * REPLACE (price * CASE WHEN p_partkey % 41 = 0 THEN 9 ELSE 1 END AS price) FROM g),
      donors AS (SELECT * FROM far WHERE p_partkey % 5 <> 1), {sql_fill("once", "far", "donors", k)},
      ends AS (SELECT {ends} FROM once WHERE p_partkey % 5 <> 1),
      masked AS (SELECT p_partkey, {masked} FROM once, ends), {sql_fill("twice", "masked", "donors", k)}
    SELECT p_partkey, {", ".join(f"round({c}, 6) AS {c}" for c in COLS)}, CASE WHEN p_partkey % 5 <> 1 THEN 'train' ELSE 'test' END AS split FROM twice"""


@query("preprocess_chain", sql_chain(5))
def preprocess_chain(spark, sf):
    """Impute, mask, impute again, fitted on the training rows."""
    x = gaps(spark, sf).withColumn("price", F.col("price") * F.when(F.col("p_partkey") % 41 == 0, 9).otherwise(1))
    train, test = x.where(F.col("p_partkey") % 5 != 1), x.where(F.col("p_partkey") % 5 == 1)
    train, test, _ = impute.preprocess(train, test, COLS, outliers.continuous_columns(train, COLS), "p_partkey", k=5)
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    return both.select("p_partkey", *[F.round(c, 6).alias(c) for c in COLS], "split")


TEXT = ["n_chars", "n_words", "n_lines", "digits", "capitals"]


def text_counts(spark, sf):
    """Counts over the whole text of every document."""
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf, "documents").select(
        "doc_id", "lang", "source",
        F.length(t).cast("double").alias("n_chars"),
        F.size(F.split(F.trim(t), r"\s+")).cast("double").alias("n_words"),
        F.size(F.split(t, "\n")).cast("double").alias("n_lines"),
        F.length(F.regexp_replace(t, "[^0-9]", "")).cast("double").alias("digits"),
        F.length(F.regexp_replace(t, "[^A-Z]", "")).cast("double").alias("capitals"),
    )


def text_features(spark, sf):
    """Counts of the labelled documents."""
    return settle(table(spark, sf, "labels").join(text_counts(spark, sf), "doc_id"))


@query("fit_logistic", """SELECT unnest(['n_chars', 'n_words', 'n_lines', 'digits', 'capitals', '(intercept)']) AS feature, count(*) AS n, 0.0e0 AS slope
    FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)""")
def fit_logistic(spark, sf):
    """Slope of the penalised loss at the fitted weights, as a share of its terms' size: zero at the optimum."""
    x = text_features(spark, sf)
    model = models.fit_logistic(x, TEXT, "quality")
    error = F.col("p") - F.col("quality")
    scored = models.predict(model, x, TEXT).withColumn("(intercept)", F.lit(1.0))
    weights = {**dict(zip(TEXT, map(float, model.coefficients), strict=True)), "(intercept)": 0.0}
    sums = scored.agg(F.count("*").alias("n"), *[e for f in weights for e in (
        F.sum(error * F.col(f"`{f}`")).alias(f"g_{f}"), F.sum(F.abs(F.col(f"`{f}`"))).alias(f"a_{f}"))])
    lines = [F.struct(F.lit(f).alias("feature"), F.col("n"), (F.round((F.col(f"`g_{f}`") + w) / F.col(f"`a_{f}`"), 3) + 0.0).alias("slope")) for f, w in weights.items()]
    return sums.select(F.inline(F.array(*lines)))


@query("fit_gbt")
def fit_gbt(spark, sf):
    """Trained on the labelled documents, all documents scored."""
    params = {"n_estimators": 10, "max_depth": 3, "scale_pos_weight": 2, "gamma": 0.5}
    model = models.fit_gbt(text_features(spark, sf), TEXT, "quality", params)
    return models.predict(model, text_counts(spark, sf), TEXT, keep=["doc_id"])


@query("search_grid")
def search_grid(spark, sf):
    """All eight settings of a space, then four around the best of them."""
    space = {"max_depth": [2, 3], "n_estimators": [3, 5], "learning_rate": [0.1, 0.3]}
    _, settings, score = models.search(
        text_features(spark, sf), TEXT, "quality", space, budget=12, n_random=8, refine=models.Around(), key="doc_id"
    )
    return spark.createDataFrame([(*settings.values(), score)], ", ".join(
        [*[f"{n} {'double' if isinstance(v, float) else 'long'}" for n, v in settings.items()], "auc double"]))


WEIGHTS, MEANS = (0.5, -0.25, 2.0), (25.0, 0.05, 0.04)


@query("linear_shap", """SELECT l_orderkey, unnest(['l_quantity', 'l_discount', 'l_tax']) AS feature, unnest([l_quantity, l_discount, l_tax]) AS value,
    unnest([0.5e0 * (l_quantity - 25.0e0), -0.25e0 * (l_discount - 0.05e0), 2.0e0 * (l_tax - 0.04e0)]) AS contribution FROM lineitem""")
def linear_shap(spark, sf):
    return explain.linear_shap(table(spark, sf, "lineitem"), "l_orderkey", ["l_quantity", "l_discount", "l_tax"], WEIGHTS, MEANS)


@query("shap_top", """WITH c AS (SELECT unnest(['l_quantity', 'l_discount', 'l_tax']) AS feature,
    unnest([0.5e0 * (l_quantity - 25.0e0), -0.25e0 * (l_discount - 0.05e0), 2.0e0 * (l_tax - 0.04e0)]) AS x FROM lineitem)
  SELECT feature, round(avg(abs(x)), 9) AS mean_abs_shap FROM c GROUP BY feature ORDER BY 2 DESC LIMIT 2""")
def shap_top(spark, sf):
    top = explain.shap_importance(linear_shap(spark, sf), 2)
    return top.withColumn("mean_abs_shap", F.round("mean_abs_shap", 9))


def residual(parts, scored):
    """Per row: features listed, and what contributions and base leave of the log-odds."""
    whole = parts.groupBy("doc_id").agg(F.count("*").alias("features"), F.sum("contribution").alias("c"), F.first("base").alias("base"))
    odds = F.log(F.col("p") / (1 - F.col("p")))
    left = F.round(F.abs(F.col("c") + F.col("base") - odds), 6)
    return whole.join(scored, "doc_id").withColumn("residual", left).drop("c", "base", "p")


@query("tree_shap", "SELECT doc_id, CAST(5 AS BIGINT) AS features, 0.0e0 AS residual FROM documents")
def tree_shap(spark, sf):
    """Contributions of all documents; with the base value they add up to the log-odds."""
    x = text_counts(spark, sf)
    model = models.fit_gbt(text_features(spark, sf), TEXT, "quality", {"n_estimators": 5, "max_depth": 3})
    return residual(explain.tree_shap(x, "doc_id", TEXT, model), models.predict(model, x, TEXT, keep=["doc_id"]).drop("pred"))


@query("extreme_rows", """(SELECT o_orderkey, o_totalprice, 'high' AS side FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 2)
  UNION ALL (SELECT o_orderkey, o_totalprice, 'low' FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 2)""")
def extreme_rows(spark, sf):
    return explain.extreme_rows(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice")


@query("explain_extremes", "SELECT unnest(['high', 'high', 'low', 'low']) AS side, CAST(5 AS BIGINT) AS features, count(*) AS scored FROM documents")
def explain_extremes(spark, sf):
    """The rows with the most extreme scores, with all their contributions."""
    x = text_counts(spark, sf)
    model = models.fit_gbt(text_features(spark, sf), TEXT, "quality", {"n_estimators": 5, "max_depth": 3})
    parts = explain.explain_extremes(model, x, "doc_id", TEXT)
    n = x.count()
    return parts.groupBy("doc_id", "side").agg(F.count("*").alias("features")).select("side", "features", F.lit(n).cast("long").alias("scored"))


RULE = """(CASE lang WHEN 'en' THEN 0.3e0 WHEN 'fr' THEN 0.2e0 ELSE 0.1e0 END + CASE WHEN toxic = 1 THEN 0.25e0 ELSE 0.0e0 END
    + CAST(n_chars % 100 AS DOUBLE) / 400.0e0)"""


def rule_score(df):
    lang = F.when(F.col("lang") == "en", 0.3).when(F.col("lang") == "fr", 0.2).otherwise(0.1)
    toxic = F.when(F.col("toxic") == 1, 0.25).otherwise(0.0)
    return df.withColumn("p", lang + toxic + (F.col("n_chars") % 100).cast("double") / 400.0)


@query("forced_value", f"""WITH {LABELLED}, f AS (
    SELECT doc_id, n_chars, toxic, v AS lang, 'lang' AS forced_col, v AS forced_value FROM d, (SELECT DISTINCT lang AS v FROM d)
    UNION ALL SELECT doc_id, n_chars, v, lang, 'toxic', CAST(v AS VARCHAR) FROM d, (VALUES (0), (1)) t(v))
  SELECT forced_col, forced_value, count(*) AS n, round(avg(p), 9) AS mean_p, min(p) AS min_p, max(p) AS max_p
  FROM (SELECT *, {RULE} AS p FROM f) GROUP BY forced_col, forced_value""")
def forced_value(spark, sf):
    d = labelled_docs(spark, sf)
    forced = fairness.forced_values(d, {"lang": encode.category_names(d, "lang", 50), "toxic": [0, 1]})
    return rule_score(forced).groupBy("forced_col", "forced_value").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 9).alias("mean_p"), F.min("p").alias("min_p"), F.max("p").alias("max_p")
    )


@query("group_score_hist", f"""WITH {LABELLED}, u AS (SELECT {RULE} AS p, unnest(['lang', 'source']) AS group_col, unnest([lang, source]) AS group_value FROM d),
  e AS (SELECT min(p) AS lo, max(p) AS hi FROM u),
  c AS (SELECT group_col, group_value, least(CAST(floor((p - lo) / (hi - lo) * 30) AS BIGINT), 29) AS bin, count(*) AS n FROM u, e GROUP BY ALL),
  g AS (SELECT group_col, group_value, CAST(r AS BIGINT) AS bin FROM (SELECT DISTINCT group_col, group_value FROM u), range(30) t(r))
  SELECT g.group_col, g.group_value, CAST(g.bin AS INTEGER) AS bin, coalesce(c.n, 0) AS n FROM g LEFT JOIN c
    ON c.group_col = g.group_col AND c.group_value = g.group_value AND c.bin = g.bin""")
def group_score_hist(spark, sf):
    out = fairness.group_score_histogram(rule_score(labelled_docs(spark, sf)), "p", ["lang", "source"])
    return out.select("group_col", "group_value", "bin", "n")


@query("forced_density", f"""WITH {LABELLED}, f AS (SELECT n_chars, toxic, v AS lang, 'lang' AS forced_col, v AS forced_value
    FROM d, (SELECT DISTINCT lang AS v FROM d)), e AS (SELECT forced_col, forced_value, {RULE} AS p FROM f),
  s AS (SELECT forced_col, forced_value, count(*) AS n, stddev_samp(p) * pow(count(*), -0.2e0) AS h, min(p) AS lo, max(p) AS hi FROM e GROUP BY ALL),
  g AS (SELECT s.*, CAST(r AS INTEGER) AS point, (lo - 3 * h) + ((hi + 3 * h) - (lo - 3 * h)) * r / 49.0e0 AS x FROM s, range(50) t(r))
  SELECT g.forced_col, g.forced_value, g.point, round(g.x, 6) AS x,
    round(sum(exp(-0.5e0 * ((g.x - e.p) / h) * ((g.x - e.p) / h)) / (n * h * sqrt(2 * pi()))), 6) AS density
  FROM g JOIN e ON e.forced_value = g.forced_value GROUP BY ALL""")
def forced_density(spark, sf):
    d = labelled_docs(spark, sf)
    out = fairness.forced_score_density(d, {"lang": encode.category_names(d, "lang", 50)}, rule_score, points=50)
    return out.withColumns({"x": F.round("x", 6), "density": F.round("density", 6)})


@query("group_score_density", f"""WITH {LABELLED}, e AS (SELECT {RULE} AS p, unnest(['lang', 'source']) AS group_col, unnest([lang, source]) AS group_value FROM d),
  s AS (SELECT group_col, group_value, count(*) AS n, stddev_samp(p) * pow(count(*), -0.2e0) AS h, min(p) AS lo, max(p) AS hi FROM e GROUP BY ALL
    HAVING stddev_samp(p) > 0),
  g AS (SELECT s.*, CAST(r AS INTEGER) AS point, (lo - 3 * h) + ((hi + 3 * h) - (lo - 3 * h)) * r / 49.0e0 AS x FROM s, range(50) t(r))
  SELECT g.group_col, g.group_value, g.point, round(g.x, 6) AS x,
    round(sum(exp(-0.5e0 * ((g.x - e.p) / h) * ((g.x - e.p) / h)) / (n * h * sqrt(2 * pi()))), 6) AS density
  FROM g JOIN e ON e.group_col = g.group_col AND e.group_value = g.group_value GROUP BY ALL""")
def group_score_density(spark, sf):
    out = fairness.group_score_density(rule_score(labelled_docs(spark, sf)), "p", ["lang", "source"], points=50)
    return out.withColumns({"x": F.round("x", 6), "density": F.round("density", 6)})


@query("group_report", f"""WITH {LABELLED}, u AS (SELECT quality AS y, CASE WHEN {RULE} >= 0.4e0 THEN 1 ELSE 0 END AS p, unnest(['lang', 'source']) AS group_col,
    unnest([lang, source]) AS group_value FROM d),
  c AS (SELECT group_col, group_value, k, CAST(count(CASE WHEN y = k AND p = k THEN 1 END) AS DOUBLE) AS hit, count(CASE WHEN y <> k AND p = k THEN 1 END) AS extra,
    count(CASE WHEN y = k AND p <> k THEN 1 END) AS missed FROM u, (VALUES (0), (1)) t(k) GROUP BY ALL),
  l AS (SELECT group_col, group_value, CAST(k AS VARCHAR) AS class, coalesce(hit / nullif(hit + extra, 0), 0) AS "precision", coalesce(hit / nullif(hit + missed, 0), 0) AS recall,
    coalesce(2 * hit / nullif(2 * hit + extra + missed, 0), 0) AS f1_score, CAST(hit + missed AS BIGINT) AS support, hit FROM c),
  r AS (SELECT * EXCLUDE (hit) FROM l
  UNION ALL SELECT group_col, group_value, 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support), CAST(sum(support) AS BIGINT) FROM l GROUP BY ALL
  UNION ALL SELECT group_col, group_value, 'macro avg', avg("precision"), avg(recall), avg(f1_score), CAST(sum(support) AS BIGINT) FROM l GROUP BY ALL
  UNION ALL SELECT group_col, group_value, 'weighted avg', sum("precision" * support) / sum(support), sum(recall * support) / sum(support),
    sum(f1_score * support) / sum(support), CAST(sum(support) AS BIGINT) FROM l GROUP BY ALL)
  SELECT group_col, group_value, class, round("precision", 9) AS "precision", round(recall, 9) AS recall, round(f1_score, 9) AS f1_score, support FROM r""")
def group_report(spark, sf):
    """All report lines per group: both classes, accuracy, macro and weighted means."""
    scored_ = rule_score(labelled_docs(spark, sf)).withColumn("pred", (F.col("p") >= 0.4).cast("int"))
    report = metrics.group_report(scored_, "quality", "pred", ["lang", "source"])
    return report.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1_score")})


QUICK = {"n_estimators": 5, "max_depth": 3}


def gappy_text(spark, sf):
    x = text_features(spark, sf)
    return x.withColumns({c: F.when(F.col("doc_id") % m != 0, F.col(c)) for c, m in (("n_words", 7), ("digits", 5))})


@query("model_grid")
def model_grid(spark, sf):
    x = gappy_text(spark, sf)
    table_, _ = analysis.model_grid(x, ["quality", "toxic"], TEXT, key="doc_id", first=QUICK, second={**QUICK, "max_bin": 16}, k=5)
    return table_


@query("run_reload", f"""WITH {LABELLED}, t AS (SELECT unnest(['lr_normalized', 'lr_standardized', 'gbt_first']) AS model)
  SELECT model, count(*) AS rows, count(*) AS same FROM d, t GROUP BY model""")
def run_reload(spark, sf):
    """A run written to a folder and read back: how many rows a model of each transform scores just as before."""
    x = gappy_text(spark, sf)
    run = analysis.run_target(x, "quality", TEXT, key="doc_id", first=QUICK, second={**QUICK, "max_bin": 16}, k=5)
    path = shared_dir(spark)
    store.save_run(run, path)
    again = store.load_run(spark, path)
    pairs = [
        run.score(name, x).select("doc_id", "model", F.col("p").alias("p")).join(again.score(name, x).select("doc_id", F.col("p").alias("q")), "doc_id")
        for name in ("lr_normalized", "lr_standardized", "gbt_first")
    ]
    return io.union_all(pairs).groupBy("model").agg(F.count("*").alias("rows"), F.count(F.when(F.col("p") == F.col("q"), 1)).alias("same"))


@query("forced_bias")
def forced_bias(spark, sf):
    x = gappy_text(spark, sf).withColumn("english", (F.col("lang") == "en").cast("int"))
    hist, _ = analysis.forced_bias(x, "quality", TEXT, "doc_id", {"english": (0, 1)}, QUICK, ["digits"], k=5)
    return hist


@query("group_scores")
def group_scores(spark, sf):
    hist, _ = analysis.group_scores(gappy_text(spark, sf), "quality", TEXT, "doc_id", ["lang"], params=QUICK, treat=["digits"], k=5)
    return hist


@query("split_training", f"""WITH {LABELLED}, c AS (SELECT quality, count(*) AS m, sum(count(*)) OVER () AS n FROM d GROUP BY quality),
  w AS (SELECT *, ceil(round(n * 0.2e0, 9)) AS wanted FROM c),
  q AS (SELECT *, row_number() OVER (ORDER BY floor(wanted * m / n) - wanted * m / n, quality) AS place FROM w)
  SELECT quality, CAST(floor(wanted * m / n) + CASE WHEN place <= wanted - sum(floor(wanted * m / n)) OVER () THEN 1 ELSE 0 END AS BIGINT) AS held_out,
    0.0e0 AS bias FROM q""")
def split_training(spark, sf):
    """A model trained on one part of the rows: held-out rows per class, and its mean error where it was trained."""
    parts = settle(stratified_split(text_features(spark, sf), "quality", "doc_id"))
    model = models.fit_logistic(parts.where("split = 'train'"), TEXT, "quality")
    scored = models.predict(model, parts, TEXT, keep=["doc_id", "quality", "split"])
    bias = scored.where("split = 'train'").agg(F.avg(F.col("p") - F.col("quality"))).first()[0]
    held = scored.where("split = 'test'").groupBy("quality").agg(F.count("*").alias("held_out"))
    return held.withColumn("bias", F.round(F.lit(bias), 3) + 0.0)

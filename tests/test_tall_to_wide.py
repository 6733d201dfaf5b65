"""Pivots, scores, codes, cohort rules."""

import pytest
from pyspark.sql import functions as F

from cohortflow.functions.numeric import clip, round_half_away, safe_ratio
from cohortflow.operators import codes, cohort, pivot, profile, scores
from cohortflow.plans import clinical_spec as spec


def test_pivot_bounds_units_and_functions(spark):
    data = [(1, 10, v) for v in (89.5, 89.6, 107.6, 107.7)] + [(1, 20, 0.0), (1, 20, 5.0), (1, 30, 400.0)]
    df = spark.createDataFrame(data, "id long, item int, value double")
    features = [
        pivot.Feature("celsius", (10,), low=32, high=42, transform=spec.fahrenheit_to_celsius),
        pivot.Feature("positive", (20,), low=0, low_open=True),
        pivot.Feature("largest", (20, 30), "max"),
        pivot.Feature("any30", (30,), "flag"),
        pivot.Feature("none", (99,), "avg"),
        pivot.Feature("n", (10,), "count"),
    ]
    row = pivot.pivot_features(df, ["id"], features, "item", "value").first()
    # 89.6 F and 107.6 F are 32 C and 42 C; their neighbours fall outside
    assert row["celsius"] == 37.0
    assert (row["positive"], row["largest"], row["any30"], row["none"], row["n"]) == (5.0, 400.0, 1, None, 4)


def test_coalesced_total_and_guarded_ratio(spark):
    df = spark.createDataFrame([(1, 1, 4.0), (1, 2, 1.005), (2, 9, 0.0), (2, 1, 3.0)], "id long, item int, value double")
    parts = [pivot.Feature(f"p{i}", (i,)) for i in (1, 2, 3)]
    zero = pivot.Feature("z", (9,))
    got = {
        r["id"]: (r["t"], r["r"])
        for r in df.groupBy("id").agg(
            pivot.coalesced_total(parts, "item", "value").alias("t"), pivot.ratio_of_means(parts[0], zero, "item", "value").alias("r")
        ).collect()
    }
    assert got == {1: (5.01, None), 2: (3.0, None)}


def test_item_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "e")
    spark.range(10).select("id", F.col("id").cast("int").alias("item"), F.lit(1.0).alias("value"), F.lit("x").alias("unused")).write.parquet(path)
    df = pivot.scan_items(spark.read.parquet(path), [pivot.Feature("a", (1, 2))], "item", "value", ["id"])
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "In(item, [1,2])" in plan and "unused" not in plan.split("ReadSchema")[1].split("\n")[0]


@pytest.mark.parametrize(
    "component, column, cases",
    [
        ("heart_rate_score", "heart_rate", {126: 6, 125: 3, 107: 3, 106.5: 0, 106: 1, 89: 1, 88.9: 0, 33: 0, 32.9: 4, None: None}),
        ("urineoutput_score", "urineoutput", {671.08: 10, 671.09: 5, 1426.99: 5, 1426.995: 0, 1427.0: 1, 2544.14: 1, 2544.15: 0, 6896.8: 0, 6896.81: 8}),
        ("age_score", "age", {23: 0, 24: 3, 53: 3, 54: 6, 77: 6, 78: 9, 89: 9, 89.5: 0, 90: 7}),
        ("gcs_score", "gcs", {0.0: 10, 7: 10, 7.01: 4, 13.99: 4, 14: 3, 14.01: 0, 15: 0}),
        ("temp_score", "temperature", {33.21: 3, 33.22: 4, 35.93: 4, 35.94: 2, 36.39: 2, 36.4: 0, 36.88: 0, 36.89: 2, 39.88: 2, 39.89: 6}),
        ("meanbp_score", "meanbp", {20.64: 4, 20.65: 3, 50.9: 3, 51: 2, 61.32: 2, 61.33: 0, 143.44: 0, 143.45: 3}),
        ("resp_rate_score", "resp_rate", {5.9: 10, 6: 1, 12.9: 1, 13: 0, 22: 0, 22.1: 1, 30.1: 6, 44: 6, 44.1: 9}),
        ("pre_icu_los_score", "pre_icu_los_minutes", {10: 5, 10.2: 3, 296: 3, 297: 0, 1439: 0, 1440: 2, 18707: 2, 18708: 1, None: None}),
        ("mechvent_score", "mechvent", {1: 9, 0: 0, None: None}),
        ("electivesurgery_score", "electivesurgery", {1: 0, 0: 6, None: None}),
    ],
)
def test_severity_points(spark, component, column, cases):
    part = next(c for c in spec.OASIS if c.name == component)
    df = spark.createDataFrame([(float(v) if v is not None else None, i) for i, v in enumerate(cases)], f"{column} double, i int")
    got = [r["p"] for r in df.orderBy("i").select(part.points().alias("p")).collect()]
    assert got == list(cases.values())


def test_missing_inputs_score_zero_and_first_match_wins(spark):
    df = spark.createDataFrame([(97.0, 100.5, None), (96.0, 101.0, 3.0), (None, None, None)], "temperature_min double, temperature_max double, wbc_min double")
    df = df.withColumns({c: F.lit(None).cast("double") for c in ("heart_rate_max", "resp_rate_max", "paco2_min", "wbc_max", "bands_max")})
    assert [r["s"] for r in scores.score(df, spec.SIRS, "s").collect()] == [1, 2, 0]


def test_prefix_literals(spark):
    data = [("I5", 10), ("I10", 10), ("I159", 10), ("J44", 10), ("J441", 10), ("J45", 10), ("57220", 9), ("57290", 9), ("4019", 10)]
    df = spark.createDataFrame([(i, c, v) for i, (c, v) in enumerate(data)], "hadm_id long, icd_code string, icd_version int")
    split = codes.split_versions(df, "icd_code", "icd_version", {9: "icd9_code", 10: "icd10_code"})
    got = {r["hadm_id"]: r for r in codes.code_flags(split, ["hadm_id"], spec.COMORBIDITIES).collect()}
    assert [got[i]["hypertension"] for i in (0, 1, 2, 8)] == [1, 1, 0, 0]
    assert [got[i]["copd"] for i in (3, 4, 5)] == [1, 1, 0]
    assert [got[i]["severe_liver_disease"] for i in (6, 7)] == [1, 0]


def test_first_per_key_breaks_ties_and_keeps_columns(spark, rows):
    df = spark.createDataFrame([(1, 5, 30, None), (1, 5, 20, "b"), (1, 6, 10, "c"), (2, 1, 1, "d")], "s long, t int, stay int, x string")
    assert rows(cohort.first_per_key(df, ["s"], ["t", "stay"])) == [(1, 5, 20, "b"), (2, 1, 1, "d")]


def test_exclude_is_by_key(spark, rows):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "s long, x string")
    assert rows(cohort.exclude(df, spark.createDataFrame([(1,), (1,)], "s long"), ["s"])) == [(2, "b")]


def test_attrition_reproduces_the_published_funnel(spark):
    """38,796 subjects with 53,178 stays, built so that each rule removes the published number."""
    n_subjects, n_stays = 38796, 53178
    df = spark.range(n_stays).select(
        (F.col("id") % n_subjects).alias("subject"), (F.col("id") >= n_subjects).alias("repeat")
    )
    s = F.col("subject")
    rules = [
        ("repeat", F.col("repeat")), ("pregnant", s < 425), ("short", s < 425 + 6555), ("long", s < 425 + 6555 + 2),
    ]
    got = [tuple(r) for r in cohort.attrition(df, "subject", rules).orderBy("step_num").collect()]
    assert [(a, c, d) for a, _, c, d in got] == [
        (1, 38796, 53178), (2, 0, 14382), (3, 38796, 38796), (4, 425, 425), (5, 38371, 38371),
        (6, 6555, 6555), (7, 31816, 31816), (8, 2, 2), (9, 31814, 31814),
    ]


def test_attrition_of_an_empty_table(spark):
    df = spark.createDataFrame([], "s long, x boolean")
    assert [(r["subject_count"], r["stay_count"]) for r in cohort.attrition(df, "s", [("x", F.col("x"))]).collect()] == [(0, 0)] * 3


def test_numeric_helpers(spark):
    df = spark.createDataFrame([(1.005, 0.0), (2.5, 1.0), (-2.5, 2.0), (None, 4.0)], "x double, d double")
    assert [r[0] for r in df.select(round_half_away(F.col("x"), 0)).collect()] == [1.0, 3.0, -3.0, None]
    assert [r[0] for r in df.select(safe_ratio(F.lit(1.0), F.col("d"), 0.0)).collect()] == [0.0, 1.0, 0.5, 0.25]
    assert [r[0] for r in df.select(clip(F.col("d"), 0.5, 2.0)).collect()] == [0.5, 1.0, 2.0, 2.0]
    # means that differ in the last bit round alike
    ties = spark.createDataFrame([(1.015,), (1.0149999999999997,), (1.0150000000000003,)], "x double")
    assert {r[0] for r in ties.select(round_half_away(F.col("x"))).collect()} == {1.02}


def test_sums_and_means_of_small_numbers(spark):
    events = spark.range(1000).select(F.lit(1).alias("k"), F.lit("a").alias("item"), F.lit(3e-7).alias("v"))
    features = [pivot.Feature("mean", ("a",), digits=None), pivot.Feature("total", ("a",), "sum")]
    got = pivot.pivot_features(events, ["k"], features, "item", "v").first()
    assert got["mean"] == pytest.approx(3e-7, rel=1e-12) and got["total"] == pytest.approx(3e-4, rel=1e-12)
    summary = profile.column_summary(events.select((F.col("v") * 100).alias("v")), digits=9).first()
    assert summary["sum"] == pytest.approx(3e-2) and summary["mean"] == pytest.approx(3e-5)
    assert pivot.pivot_features(events.where("v IS NULL").union(events.limit(1).selectExpr("k", "'b'", "v")), ["k"], features, "item", "v").first()["mean"] is None

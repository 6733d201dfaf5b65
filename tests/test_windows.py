import math
import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cohortflow.functions.times import calendar_years, plus, whole_hours
from cohortflow.operators import windows

T0 = datetime(2020, 1, 1, 8)
HOUR, SECOND = timedelta(hours=1), timedelta(seconds=1)


@pytest.fixture(scope="module")
def anchors(spark):
    df = spark.createDataFrame([(1, T0), (2, T0), (3, T0)], "id long, intime timestamp_ntz")
    return df.withColumn("day_end", plus(F.col("intime"), hours=24))


@pytest.fixture(scope="module")
def events(spark):
    day = 24 * HOUR
    data = [
        (1, T0, "at start"), (1, T0 - SECOND, "before"), (1, T0 + day, "at end"), (1, T0 + day + SECOND, "after"),
        (2, T0 + HOUR, "inside"), (9, T0, "other id"),
    ]
    return spark.createDataFrame(data, "id long, ts timestamp_ntz, what string")


@pytest.mark.parametrize("salts", [1, 5])
def test_both_ends_count(anchors, events, rows, salts):
    hits = windows.events_in_window(anchors, events, ["id"], "ts", "intime", "day_end", salts=salts)
    assert rows(hits, "id", "what") == [(1, "at end"), (1, "at start"), (2, "inside")]


def test_open_start_and_strict_end(anchors, events, rows):
    hits = windows.events_in_window(anchors, events, ["id"], "ts", None, "day_end", end_open=True)
    assert rows(hits, "what") == [("at start",), ("before",), ("inside",)]


def test_point_in_interval_may_match_several_or_none(spark, anchors, rows):
    spans = spark.createDataFrame(
        [(1, T0 - HOUR, T0, "a"), (1, T0, T0 + HOUR, "b"), (2, T0 + SECOND, T0 + HOUR, "c")],
        "id long, s timestamp_ntz, e timestamp_ntz, what string",
    )
    assert rows(windows.points_in_intervals(anchors, spans, ["id"], "intime", "s", "e"), "id", "what") == [(1, "a"), (1, "b")]


def test_overlap_touching_the_edges(spark, anchors, rows):
    end = T0 + 24 * HOUR
    spans = spark.createDataFrame(
        [(1, T0 - HOUR, T0, "ends at start"), (1, end, end + HOUR, "starts at end"), (1, end + SECOND, end + HOUR, "late"),
         (2, T0 - HOUR, T0 - SECOND, "early")],
        "id long, s timestamp_ntz, e timestamp_ntz, what string",
    )
    hits = windows.intervals_overlapping(anchors, spans, ["id"], "s", "e", "intime", "day_end")
    assert rows(hits, "what") == [("ends at start",), ("starts at end",)]


def test_attach_and_any_match_keep_unmatched_anchors(spark, anchors, events, rows):
    hits = windows.events_in_window(anchors, events, ["id"], "ts", "intime", "day_end")
    counts = hits.groupBy("id").agg(F.count("what").alias("n"))
    assert rows(windows.attach(anchors.select("id"), [counts], ["id"], {"n": 0})) == [(1, 2), (2, 1), (3, 0)]
    assert rows(windows.any_match(anchors.select("id"), [hits, hits], ["id"], "hit")) == [(1, 1), (2, 1), (3, 0)]


def test_a_hot_key_is_split_without_losing_rows(spark):
    anchors = spark.createDataFrame([(i, T0) for i in range(20)], "id long, intime timestamp_ntz").withColumn(
        "day_end", plus(F.col("intime"), hours=24)
    )
    events = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 20).alias("id"),
        F.lit(T0).cast("timestamp_ntz").alias("ts"), F.lit(1).alias("v"),
    )
    want = {r["id"]: r["count"] for r in events.groupBy("id").count().collect()}
    for salts in (1, 8):
        hits = windows.events_in_window(anchors, events, ["id"], "ts", "intime", "day_end", salts=salts)
        assert {r["id"]: r["count"] for r in hits.groupBy("id").count().collect()} == want


def _pairs(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("kind, width", [("double", None), ("double", 3.0), ("timestamp_ntz", None), ("timestamp", 900), ("date", None), ("decimal(9,3)", None)])
def test_cells_give_the_same_rows_as_a_plain_join(spark, kind, width):
    """Windows of all lengths, reversed and without an end; far outliers; infinite numbers."""
    rng = random.Random(7)
    day = datetime(2190, 1, 1)

    def time(v):
        if v is None or kind == "double":
            return v if v is None else float(v)
        if kind.startswith("decimal"):
            return Decimal(str(round(v, 3)))
        at = day + timedelta(days=v) if kind == "date" else day + timedelta(minutes=v)
        return at.date() if kind == "date" else at

    def window():
        s = rng.choice([rng.uniform(-50, 200), rng.randint(0, 100), None])
        e = None if s is None else s + rng.choice([0, rng.uniform(-5, 30), 1, 5000, None or 2])
        return (s, e) if rng.random() > 0.05 else (s, None)

    infinite = [(1, "inf", -math.inf, math.inf), (2, "up", 3.0, math.inf), (2, "nan", 3.0, math.nan)] if kind == "double" else []
    a = [(rng.randint(0, 3), f"a{n}", *map(time, window())) for n in range(120)] + infinite
    b = [(rng.randint(0, 3), f"b{n}", *map(time, window())) for n in range(200)] + [(k, f"b{n}", s, e) for k, n, s, e in infinite]
    a = spark.createDataFrame(a, f"k int, a string, s {kind}, e {kind}").repartition(3)
    b = spark.createDataFrame(b, f"k int, b string, t {kind}, u {kind}").repartition(2)
    a.createOrReplaceTempView("side_a")
    b.createOrReplaceTempView("side_b")
    join = "SELECT a, b FROM side_a JOIN side_b ON side_a.k = side_b.k AND "
    for found, condition in (
        (windows.events_in_window(a, b, ["k"], "t", "s", "e", width=width), "t BETWEEN s AND e"),
        (windows.events_in_window(a, b, ["k"], "t", "s", "e", end_open=True, width=width), "t >= s AND t < e"),
        (windows.points_in_intervals(b, a, ["k"], "t", "s", "e", width=width), "t BETWEEN s AND e"),
        (windows.intervals_overlapping(a, b, ["k"], "t", "u", "s", "e", width=width), "u >= s AND t <= e"),
    ):
        assert _pairs(found, "a", "b") == _pairs(spark.sql(join + condition), "a", "b")
        assert {"_cell", "_first", "_salt"}.isdisjoint(found.columns)


def test_times_of_different_types_are_joined_by_key(spark):
    a = spark.createDataFrame([(1, T0)], "k int, s timestamp_ntz").withColumn("e", F.col("s").cast("timestamp"))
    b = spark.createDataFrame([(1, T0.date() + timedelta(days=0))], "k int, t date")
    hits = windows.events_in_window(a, b.withColumn("t", F.col("t").cast("timestamp")), ["k"], "t", "s", "e")
    assert hits.count() == 0 and "_cell" not in hits._jdf.queryExecution().toString()


def test_clock_changes_do_not_part_a_window_from_its_events(spark):
    """Local times that the clock skips keep their order."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        a = spark.sql("SELECT 1 AS k, TIMESTAMP_NTZ'2020-03-29 02:20:00' AS s, TIMESTAMP_NTZ'2020-03-29 03:10:00' AS e")
        b = spark.sql("SELECT 1 AS k, explode(array(TIMESTAMP_NTZ'2020-03-29 02:30:00', TIMESTAMP_NTZ'2020-03-29 03:05:00')) AS t")
        assert windows.events_in_window(a, b, ["k"], "t", "s", "e", width=60).count() == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_one_key_with_many_windows_and_events_is_near_linear(spark):
    """100,000 windows and 1,000,000 events of one key: the rows that meet are a small multiple of the matches."""
    a = spark.range(100_000).select(F.lit(1).alias("k"), (F.col("id") * 10.0).alias("s"), (F.col("id") * 10.0 + F.col("id") % 7).alias("e"))
    b = spark.range(0, 1_000_000, 1, 8).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("t"))
    hits = windows.events_in_window(a, b, ["k"], "t", "s", "e")
    assert hits.count() == sum(n % 7 + 1 for n in range(100_000))
    assert "_cell" in hits._jdf.queryExecution().optimizedPlan().toString()
    cut = windows._in_cells(a, windows.Span("s", "e"), 3.0, None, None)
    assert cut.count() < 3 * 100_000


def test_time_arithmetic(spark):
    s, e = datetime(2000, 12, 31), datetime(2001, 1, 1)
    df = spark.createDataFrame([(s, e, 2000)], "s timestamp_ntz, e timestamp_ntz, y int")
    row = df.select(
        whole_hours(F.col("s"), F.col("e") - F.expr("INTERVAL '1' MINUTE")).alias("h"), calendar_years(F.col("y"), F.col("e")).alias("years")
    ).first()
    assert (row["h"], row["years"]) == (23, 1)


def test_adaptive_execution_splits_the_hot_key(spark):
    """With small limits in place of the cluster's, the oversized join partition is split."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        anchors = spark.range(500).select("id", F.lit(T0).cast("timestamp_ntz").alias("intime")).withColumn(
            "day_end", plus(F.col("intime"), hours=24)
        )
        events = spark.range(0, 200_000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).alias("id"),
            F.lit(T0).cast("timestamp_ntz").alias("ts"), F.col("id").alias("v"),
        )
        counts = windows.events_in_window(anchors, events, ["id"], "ts", "intime", "day_end").groupBy("id").agg(F.count("v").alias("n"))
        got = {r["id"]: r["n"] for r in counts.collect()}
        plan = counts._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sum(got.values()) == 200_000 and got[0] >= 66_667
    assert "skew=true" in plan


def test_a_sieve_lets_all_wanted_keys_through(spark):
    keys = spark.range(0, 2000, 40).withColumnRenamed("id", "k")
    rows_ = spark.range(2000).selectExpr("id AS k", "id * 2 AS v").unionByName(spark.createDataFrame([(None, 5)], "k long, v long"))
    found = windows.sift(rows_, keys, "k")
    got = {r["k"]: r["v"] for r in found.collect()}
    assert found.columns == ["k", "v"]
    assert all(got[k] == 2 * k for k in range(0, 2000, 40))
    # one in eight of the others, more or less
    assert len(got) < 50 + 2 * 1950 / windows.SIEVE_BITS
    assert windows.sift(rows_, keys.where("k < 0"), "k").count() == 0


def test_a_sieve_with_few_words_still_lets_all_through(spark, monkeypatch):
    monkeypatch.setattr(windows, "SIEVE_WORDS", 1)
    keys = spark.range(0, 2000, 40).withColumnRenamed("id", "k")
    found = windows.sift(spark.range(2000).withColumnRenamed("id", "k"), keys, "k")
    assert found.join(keys, "k").count() == 50

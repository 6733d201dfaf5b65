"""Descriptive tables: column summaries, group shares, histograms, densities."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.functions.numeric import round_half_away
from cohortflow.operators.encode import distinct_values, numeric_columns, unpivot_groups
from cohortflow.operators.ordered import exact_quantiles


BROADCAST_GROUPS = 100_000  # of a few numbers each
# a kernel so many bandwidths away is zero in double precision; half a bucket more, as buckets count from their middle
REACH = 39.5
# terms of the series for offsets of at most half a bandwidth
ORDERS = 22


def null_counts(df: DataFrame) -> DataFrame:
    """Per column: type, number of rows, number of nulls."""
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in df.columns])
    rows = [
        F.struct(
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
            F.col("_n").alias("n_rows"),
            (F.col("_n") - F.col(f.name)).alias("n_missing"),
        )
        for f in df.schema
    ]
    return one.select(F.inline(F.array(*rows)))


def column_summary(df: DataFrame, digits: int = 2) -> DataFrame:
    """Moments, median, range, sum and non-null count per column; text columns only count."""
    numeric = numeric_columns(df)
    medians = exact_quantiles(df, numeric, [0.5]) if numeric else {}
    aggs = [F.count(c).alias(f"n_{c}") for c in df.columns]
    for c in numeric:
        x = F.col(c).cast("double")
        aggs += [
            F.avg(x).alias(f"mean_{c}"),
            F.var_samp(x).alias(f"var_{c}"),
            F.min(x).alias(f"min_{c}"),
            F.max(x).alias(f"max_{c}"),
            F.sum(x).alias(f"sum_{c}"),
        ]
    one = df.agg(*aggs)

    def line(c: str) -> Column:
        is_num = c in numeric

        def value(name: str, expr) -> Column:
            x = round_half_away(expr, digits) if is_num else F.lit(None)
            return x.cast("double").alias(name)

        return F.struct(
            F.lit(c).alias("column"),
            F.lit("Numerical" if is_num else "Categorical").alias("type"),
            value("mean", F.col(f"mean_{c}") if is_num else None),
            value("variance", F.col(f"var_{c}") if is_num else None),
            value("std_dev", F.sqrt(F.col(f"var_{c}")) if is_num else None),
            value("median", F.lit(medians[c][0]).cast("double") if is_num else None),
            value("min", F.col(f"min_{c}") if is_num else None),
            value("max", F.col(f"max_{c}") if is_num else None),
            value("sum", F.col(f"sum_{c}") if is_num else None),
            F.col(f"n_{c}").alias("count"),
        )

    return one.select(F.inline(F.array(*[line(c) for c in df.columns])))


def group_mean(df: DataFrame, groups: Sequence[str], value: str, name: str) -> DataFrame:
    """Mean of ``value`` per group, largest first. Rows without a value for some group column are left out."""
    mean = F.avg(F.col(value).cast("double")).alias(name)
    return df.dropna(subset=list(groups)).groupBy(*groups).agg(mean).orderBy(F.desc(name), *groups)


def rates_by_group(df: DataFrame, labels: Sequence[str], group_columns: Sequence[str]) -> DataFrame:
    """``1 - mean(label)`` per observed value of each group column."""
    long = unpivot_groups(df, labels, group_columns).where(F.col("group_value").isNotNull())
    rates = [(F.lit(1.0) - F.avg(F.col(y).cast("double"))).alias(f"survival_{y}") for y in labels]
    return long.groupBy("group_col", "group_value").agg(F.count(F.lit(1)).alias("n"), *rates)


def category_percent(
    df: DataFrame, categories: dict[str, Column], by: str, group_columns: Sequence[str], digits: int = 2
) -> DataFrame:
    """Share of each group value within (category, ``by`` value), in percent.

    A row may fall into several categories. Values that occur in a category but not for some ``by``
    value are listed there with 0.
    """
    member = F.filter(
        F.array(*[F.when(cond, F.lit(name)) for name, cond in categories.items()]), lambda c: c.isNotNull()
    )
    tagged = df.withColumn("category", F.explode(member)).withColumn("by_value", F.col(by).cast("string"))
    counts = (
        unpivot_groups(tagged, ["category", "by_value"], group_columns)
        .where(F.col("group_value").isNotNull() & F.col("by_value").isNotNull())
        .groupBy("category", "by_value", "group_col", "group_value")
        .count()
    )
    # every group value of a category meets every ``by`` value: through the category, which both have
    groups = counts.select("category", "group_col", "group_value").distinct()
    by_values = distinct_values(df.select(F.col(by).cast("string").alias("by_value")), "by_value")
    named = F.explode(F.array(*[F.lit(c) for c in categories])).alias("category")
    wanted = groups.join(by_values.select("by_value", named), "category")
    filled = wanted.join(counts, ["category", "by_value", "group_col", "group_value"], "left").select(
        "category", "group_col", "group_value", "by_value", F.coalesce("count", F.lit(0)).alias("n")
    )
    total = F.sum("n").over(Window.partitionBy("category", "by_value", "group_col"))
    percent = round_half_away(F.coalesce(F.lit(100.0) * F.col("n") / F.nullif(total, F.lit(0)), F.lit(0.0)), digits)
    return filled.select("category", "by_value", "group_col", "group_value", "n", percent.alias("percent"))


def with_group_rows(rows: DataFrame, per_group: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Attach one row of statistics per group. Few groups are broadcast, as a shuffle by a handful of keys would leave
    their rows to a handful of tasks; with many groups the keys themselves spread the rows."""
    few = per_group.count() <= BROADCAST_GROUPS
    return rows.join(F.broadcast(per_group) if few else per_group, list(groups))


def histogram(
    df: DataFrame,
    value: str,
    bins: int,
    groups: Sequence[str] = (),
    own_range: bool = False,
    limits: tuple[float, float] | None = None,
) -> DataFrame:
    """Equal-width bins, the last one closed, with count and density; empty bins are listed.

    All groups share one range unless ``own_range`` is set.
    """
    x = F.col(value).cast("double")
    rows = df.where(x.isNotNull()).select(*groups, x.alias("_x"))
    ends = [F.min("_x").alias("_lo"), F.max("_x").alias("_hi")]
    if own_range and groups:
        rows = with_group_rows(rows, rows.groupBy(*groups).agg(*ends), groups)
    else:
        lo, hi = limits or rows.agg(*ends).first()
        rows = rows.withColumns({"_lo": F.lit(lo).cast("double"), "_hi": F.lit(hi).cast("double")})
    flat = F.col("_lo") == F.col("_hi")
    rows = rows.withColumns(
        {"_lo": F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")),
         "_hi": F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi"))}
    )
    place = F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)
    counted = rows.groupBy(*groups, "_lo", "_hi", F.least(place, F.lit(bins - 1)).alias("bin")).count()
    per_group = counted.groupBy(*groups, "_lo", "_hi").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "count"))).alias("_n"), F.sum("count").alias("_total")
    )
    full = per_group.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    width = (F.col("_hi") - F.col("_lo")) / bins
    n = F.coalesce(F.col("_n")[F.col("bin")], F.lit(0)).cast("long")
    return full.select(
        *groups,
        F.col("bin").cast("int").alias("bin"),
        (F.col("_lo") + F.col("bin") * width).alias("left_edge"),
        n.alias("n"),
        (n / (F.col("_total") * width)).alias("density"),
    )


def boxplot_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Quartiles, whisker ends (the furthest data within 1.5 IQR) and outlier counts per column."""
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    aggs = []
    for c in columns:
        q1, _, q3 = quartiles[c]
        x = F.col(c).cast("double")
        low, high = (None, None) if q1 is None else (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
        aggs += [
            F.min(F.when(x >= F.lit(low), x)).alias(f"lo_{c}"),
            F.max(F.when(x <= F.lit(high), x)).alias(f"hi_{c}"),
            F.count(F.when((x < F.lit(low)) | (x > F.lit(high)), 1)).alias(f"out_{c}"),
        ]
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            *[F.lit(q).cast("double").alias(n) for n, q in zip(("q1", "median", "q3"), quartiles[c], strict=True)],
            F.col(f"lo_{c}").alias("whisker_low"),
            F.col(f"hi_{c}").alias("whisker_high"),
            F.col(f"out_{c}").alias("n_outliers"),
        )
        for c in columns
    ]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def kde_grid(df: DataFrame, value: str, groups: Sequence[str] = (), points: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density with Scott's bandwidth on an even grid per group.

    The grid reaches ``cut`` bandwidths beyond the data. Groups with no spread have no density and are left out.

    Values are not taken to the points of the grid. They are first summed up in buckets one bandwidth wide, as moments
    around the middle; a bucket's kernels at a point follow from its moments by a Hermite series, whose ``ORDERS`` terms
    leave no more than rounding. Buckets meet only the points within ``REACH`` bandwidths, beyond which a kernel is zero
    in double precision. So what is joined depends on the spread of the data in bandwidths, not on its rows.
    """
    x = F.col(value).cast("double")
    present = df.where(x.isNotNull())
    aggs = [F.count(F.lit(1)).alias("_n"), F.stddev_samp(x).alias("_sd"), F.min(x).alias("_lo"), F.max(x).alias("_hi")]
    rows = present.select(*groups, x.alias("_x"))
    if groups:
        stats = present.groupBy(*groups).agg(*aggs)
        rows = with_group_rows(rows, stats, groups)
    else:
        # one row of statistics: numbers in the plan, not a join
        one = present.agg(*aggs).first()
        numbers = {"_n": F.lit(one["_n"]).cast("long"), **{c: F.lit(one[c]).cast("double") for c in ("_sd", "_lo", "_hi")}}
        rows = rows.withColumns(numbers)
        stats = df.sparkSession.range(1).select(*[e.alias(c) for c, e in numbers.items()])
    h = F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))
    rows = rows.where(F.col("_sd") > 0).withColumn("_z", (F.col("_x") - F.col("_lo")) / h)
    rows = rows.withColumn("_bucket", F.floor("_z"))
    off = F.col("_z") - F.col("_bucket") - 0.5
    moments = [F.sum(F.pow(off, F.lit(float(k)))) / F.lit(float(math.factorial(k))) for k in range(ORDERS)]
    buckets = rows.groupBy(*groups, "_bucket", "_n", "_sd", "_lo", "_hi").agg(F.array(*moments).alias("_m"))

    # places in bandwidths from the smallest value
    width = (F.col("_hi") - F.col("_lo")) / h
    step = (width + 2 * cut) / F.lit(float(points - 1))
    near = [F.ceil((F.col("_bucket") + 0.5 - REACH + cut) / step), F.floor((F.col("_bucket") + 0.5 + REACH + cut) / step)]
    first, last = F.greatest(near[0], F.lit(0)), F.least(near[1], F.lit(points - 1))
    pairs = buckets.withColumn("point", F.explode(F.when(first <= last, F.sequence(first, last))))
    z = F.col("point") * step - cut - F.col("_bucket") - 0.5
    start = F.struct(F.lit(0.0).alias("before"), F.lit(1.0).alias("now"), F.lit(0.0).alias("k"), F.lit(0.0).alias("sum"))
    series = F.aggregate(
        F.col("_m"), start,
        lambda a, m: F.struct(
            a["now"].alias("before"), (F.col("_at") * a["now"] - a["k"] * a["before"]).alias("now"), (a["k"] + 1).alias("k"), (a["sum"] + m * a["now"]).alias("sum")
        ),
        lambda a: a["sum"],
    )
    kernel = F.exp(F.lit(-0.5) * F.col("_at") * F.col("_at")) * series
    sums = pairs.withColumn("_at", z).groupBy(*groups, "point").agg(F.sum(kernel).alias("_k"))

    grid = stats.where(F.col("_sd") > 0).withColumn("point", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))))
    begin, stop = F.col("_lo") - cut * h, F.col("_hi") + cut * h
    at = begin + (stop - begin) * F.col("point") / F.lit(float(points - 1))
    density = F.coalesce("_k", F.lit(0.0)) / (F.col("_n") * h * F.lit(math.sqrt(2 * math.pi)))
    full = grid.join(sums, [*groups, "point"], "left")
    return full.select(*groups, F.col("point").cast("int").alias("point"), at.alias("x"), F.greatest(density, F.lit(0.0)).alias("density"))

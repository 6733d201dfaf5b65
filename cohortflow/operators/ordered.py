"""Ranks, running totals and exact quantiles over a whole column.

A window without a partition key would sort the column in one task. Here equal values are first
combined (so a value that fills a third of the rows becomes one row), then dealt into sorted ranges by one exchange. Each
range is summed on its own, and the totals of the ranges, a table of their number, supply the offsets. Where the
caller knows borders, ordered buckets take the place of the ranges.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from cohortflow.session import settle

LEAST_BUCKETS = 16


def cut_points(distinct: DataFrame, value: str, buckets: int | None = None) -> list[float]:
    """Approximate quantiles of ``value`` as ascending bucket borders for a Bucketizer.

    ``distinct`` should hold every value once, so that a value with most of the rows does not take most of the
    borders. By default there are an eighth of the root of their number, ``LEAST_BUCKETS`` at least.
    """
    x = F.col(value).cast("double")
    if buckets is None:
        buckets = max(LEAST_BUCKETS, math.isqrt(distinct.count()) // 8)
    probs = [i / buckets for i in range(1, buckets)]
    return as_borders(distinct.agg(F.percentile_approx(x, probs, 10 * buckets)).first()[0])


def as_borders(cuts: Sequence[float] | None) -> list[float]:
    """Open-ended borders from cut points; there is always at least one inner border."""
    return [-math.inf, *(sorted(set(cuts or [])) or [0.0]), math.inf]


def add_bucket(df: DataFrame, value: str, name: str, borders: list[float]) -> DataFrame:
    """Number of the interval between ``borders`` that holds ``value``."""
    wide = df.withColumn("_v", F.col(value).cast("double"))
    return Bucketizer(splits=borders, inputCol="_v", outputCol=name, handleInvalid="keep").transform(wide).drop("_v")


def running_sums(
    df: DataFrame,
    value: str,
    sums: dict[str, Column],
    groups: Sequence[str] = (),
    borders: list[float] | None = None,
    bucket: str | None = None,
) -> DataFrame:
    """One row per distinct value with, for each entry of ``sums``, the amount at this value
    (``x``), at all smaller values (``x_before``) and in the whole group (``x_total``).

    By default the combined values are written and put in order by one range exchange. A caller that knows bucket limits
    gives them as ``borders``, one whose groups differ in scale a ``bucket`` column, which must grow with the value inside
    each group; then nothing runs before the result is asked for. Rows with a null value are ignored.
    """
    rows = df.where(F.col(value).isNotNull())
    aggs = [e.alias(k) for k, e in sums.items()]
    if bucket is None and borders is None:
        return _ranged_sums(settle(rows.groupBy(*groups, value).agg(*aggs)), value, list(sums), list(groups))
    if bucket is None:
        bucketed = add_bucket(rows.groupBy(*groups, value).agg(*aggs), value, "_bucket", borders)
    else:
        bucketed = rows.groupBy(*groups, value, F.col(bucket).alias("_bucket")).agg(*aggs)
    bucketed = bucketed.withColumn("_g", F.struct(F.lit(0), *groups))

    inside = Window.partitionBy("_g", "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = bucketed.withColumns({f"_in_{k}": F.sum(k).over(inside) - F.col(k) for k in sums})

    before = Window.partitionBy("_g").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_g")
    totals = bucketed.groupBy("_g", "_bucket").agg(*[F.sum(k).alias(f"_t_{k}") for k in sums])
    offsets = totals.select(
        "_g",
        "_bucket",
        *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums],
        *[F.sum(f"_t_{k}").over(whole).alias(f"{k}_total") for k in sums],
    )
    joined = local.join(offsets, ["_g", "_bucket"])
    return joined.select(
        *groups,
        value,
        *sums,
        *[(F.col(f"_o_{k}") + F.col(f"_in_{k}")).alias(f"{k}_before") for k in sums],
        *[f"{k}_total" for k in sums],
    )


def _ranged_sums(per_value: DataFrame, value: str, sums: list[str], groups: list[str]) -> DataFrame:
    """:func:`running_sums` of combined values: one exchange into sorted ranges, a running total in each, and the totals
    of earlier ranges from a table with a row per range and group."""
    order = [*groups, value]
    ordered = per_value.select(*order, *sums).repartitionByRange(*order).sortWithinPartitions(*order)
    own_fields = ordered.schema.fields
    more = [StructField(f"_in_{k}", ordered.schema[k].dataType) for k in sums]
    schema = StructType([*own_fields, *more, StructField("_range", IntegerType())])
    at = [ordered.columns.index(k) for k in sums]
    own = range(len(groups))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held = TaskContext.get().partitionId(), None, [0] * len(at)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            codes = [pc.dictionary_encode(batch.column(c), null_encoding="encode").indices.to_numpy(zero_copy_only=False) for c in own]
            new = np.zeros(n, bool)
            for c in codes:
                new[1:] |= c[1:] != c[:-1]
            key = tuple(batch.column(c)[0].as_py() for c in own)
            begin = np.flatnonzero(new)
            first = np.zeros(n, int)
            first[begin] = begin
            first = np.maximum.accumulate(first)
            out = []
            for i, c in enumerate(at):
                x = pc.fill_null(batch.column(c), 0).to_numpy(zero_copy_only=False)
                before = np.concatenate([[x[0] * 0], np.cumsum(x)[:-1]])
                before = before - before[first]
                if key == last:
                    before[: begin[0] if len(begin) else n] += held[i]
                held[i] = before[-1] + x[-1]
                out.append(pa.array(before, batch.schema.field(c).type))
            last = tuple(batch.column(c)[n - 1].as_py() for c in own)
            yield pa.RecordBatch.from_arrays([*batch.columns, *out, pa.array(np.full(n, part, np.int32))], names=[*batch.schema.names, *[f"_in_{k}" for k in sums], "_range"])

    placed = settle(ordered.mapInArrow(run, schema)).withColumn("_g", F.struct(F.lit(0), *groups))
    before = Window.partitionBy("_g").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_g")
    totals = placed.groupBy("_g", "_range").agg(*[F.sum(k).alias(f"_t_{k}") for k in sums])
    offsets = totals.select(
        "_g", "_range", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums],
        *[F.sum(f"_t_{k}").over(whole).alias(f"{k}_total") for k in sums],
    )
    joined = placed.join(offsets, ["_g", "_range"])
    return joined.select(*order, *sums, *[(F.col(f"_o_{k}") + F.col(f"_in_{k}")).alias(f"{k}_before") for k in sums], *[f"{k}_total" for k in sums])


def average_ranks(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """Distinct values with their tie-averaged rank and the group size ``n``."""
    r = running_sums(df, value, {"cnt": F.count(F.lit(1))}, groups)
    rank = F.col("cnt_before") + (F.col("cnt") + 1) / F.lit(2.0)
    return r.select(*groups, value, rank.alias("avg_rank"), F.col("cnt_total").alias("n"))


def ecdf(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """Empirical distribution function just below and at each distinct value."""
    r = running_sums(df, value, {"cnt": F.count(F.lit(1))}, groups)
    total = F.col("cnt_total")
    return r.select(
        *groups,
        value,
        (F.col("cnt_before") / total).alias("ecdf_below"),
        ((F.col("cnt_before") + F.col("cnt")) / total).alias("ecdf"),
        total.alias("n"),
    )


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation, per column, as driver-side numbers.

    All columns are ranked together, as (column, value) pairs; only the values at the wanted ranks return.
    """
    sizes = df.agg(*[F.count(c).alias(c) for c in columns]).first().asDict()
    places = {c: [p * (n - 1) for p in probs] for c, n in sizes.items() if n}
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in columns}
    if not places:
        return out
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in places]
    long = df.select(F.inline(F.array(*cells)))
    ranked = running_sums(long, "value", {"cnt": F.count(F.lit(1))}, ["column"])
    first, last = F.col("cnt_before"), F.col("cnt_before") + F.col("cnt")
    wanted = F.lit(False)
    for c, at in places.items():
        ranks = sorted({k for pos in at for k in (math.floor(pos), math.ceil(pos))})
        hit = F.exists(F.array(*[F.lit(k) for k in ranks]), lambda k: (k >= first) & (k < last))
        wanted = wanted | ((F.col("column") == c) & hit)
    hits = ranked.where(wanted).collect()

    def value(c: str, k: int) -> float:
        return next(r["value"] for r in hits if r["column"] == c and r["cnt_before"] <= k < r["cnt_before"] + r["cnt"])

    for c, at in places.items():
        low = [value(c, math.floor(pos)) for pos in at]
        high = [value(c, math.ceil(pos)) for pos in at]
        out[c] = [lo + (pos - math.floor(pos)) * (hi - lo) for lo, hi, pos in zip(low, high, at, strict=True)]
    return out

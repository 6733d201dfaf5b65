"""Joins between anchors (entity plus time window) and timed rows.

Every join here carries an equality key, so Spark hashes on the key and tests the time condition as
a residual. Small anchor tables are broadcast by Spark's own size check; beyond it both sides shuffle.

Windows with two ends are joined by key and time cell. A window is repeated for every cell that it touches and a point
falls into one, so the rows of a key meet only where their times are near, however many windows and events the key has.
Cells are as wide as the windows are on average, by default as measured: then all windows together touch at most three
cells for each of them, whatever their lengths are. Of two windows that overlap, the pair is made in the first cell
that both touch, and nowhere else.

The timed side may have one key with a large share of all rows. Cells spread it, and the shuffle also hashes a bucket of
the key: a later aggregation by the key then needs its own exchange of partial results, which leaves adaptive execution
free to split an oversized join partition over several tasks. All joins are inner, as only those may be split on either
side; callers aggregate the matches and bring back the unmatched anchors with :func:`attach`. Where adaptive execution
is off, ``salts`` splits each key over a fixed number of tasks by repeating the (much smaller) anchor rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 1
KEY_BUCKETS = 65536
# width of a cell where all windows are points
LEAST_WIDTH = 1.0
MANY = 4096
SIEVE_BITS = 8
SIEVE_WORDS = 1 << 20


def _bucket(on: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*on), F.lit(KEY_BUCKETS)).cast("int")


def _salted(anchors: DataFrame, rows: DataFrame, on: Sequence[str], salts: int):
    if salts <= 1:
        return anchors.withColumn("_salt", _bucket(on)), rows.withColumn("_salt", _bucket(on)), [*on, "_salt"]
    # a hash of the whole row is stable when a lost task is run again, unlike a random salt
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(salts)).cast("int")
    spread = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    return anchors.withColumn("_salt", spread), rows.withColumn("_salt", salt), [*on, "_salt"]


def timed_join(anchors: DataFrame, rows: DataFrame, on: Sequence[str], condition: Column, salts: int = SALTS) -> DataFrame:
    """Inner join on ``on`` and ``condition``, which names the sides ``a`` and ``r``.

    Gives the anchor columns and those of ``rows`` that the anchors lack.
    """
    anchors, rows, keys = _salted(anchors, rows, on, salts)
    a, r = anchors.alias("a"), rows.alias("r")
    equal = reduce(Column.__and__, [F.col(f"a.{k}") == F.col(f"r.{k}") for k in keys])
    joined = a.join(r, equal & condition, "inner")
    extra = [f"r.{c}" for c in rows.columns if c not in anchors.columns]
    return joined.select("a.*", *extra).drop("_salt")


@dataclass(frozen=True)
class Span:
    """Columns of one side that hold its time: a point, or where a window begins and ends."""

    start: str
    end: str | None = None


TIMES = ("timestamp", "timestamp_ntz", "date")
NUMBERS = ("int", "bigint", "smallint", "tinyint", "float", "double")


def _tick(df: DataFrame, column: str) -> Column:
    """The time as a number that never falls where the time rises: seconds, or the number itself."""
    kind, c = dict(df.dtypes)[column], F.col(column)
    if kind in NUMBERS or kind.startswith("decimal"):
        return c.cast("double")
    if kind == "date":
        return F.unix_date(c).cast("double") * 86400
    if kind == "timestamp":
        return F.unix_seconds(c).cast("double")
    # from the fields of the local time, which no change of the clock turns back
    return F.unix_date(c.cast("date")).cast("double") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def _comparable(sides: Sequence[tuple[DataFrame, Span]]) -> bool:
    """Whether all times are of one type, or all numbers, so that cells of both sides agree."""
    kinds = {dict(df.dtypes)[c] for df, span in sides for c in (span.start, span.end) if c is not None}
    numbers = {k for k in kinds if k in NUMBERS or k.startswith("decimal")}
    return kinds == numbers or (len(kinds) == 1 and kinds <= set(TIMES))


def measure(sides: Sequence[tuple[DataFrame, Span]]) -> tuple[float, float | None, float | None]:
    """Mean length of the windows of each side, the largest of them, and the least and greatest finite time of a window.

    Lengths are in seconds, or in the unit of a number. One pass over each side that has windows.
    """
    found = []
    for df, span in sides:
        if span.end is not None:
            ticks = [_tick(df, span.start), _tick(df, span.end)]
            finite = [F.when(F.abs(t) < float("inf"), t) for t in ticks]
            found.append(df.agg(F.avg(F.abs(finite[1] - finite[0])), *[f(t) for f in (F.min, F.max) for t in finite]).first())
    ends = [[v for r in found for v in r[k : k + 2] if v is not None] for k in (1, 3)]
    return max(r[0] or 0.0 for r in found), min(ends[0], default=None), max(ends[1], default=None)


def _in_cells(df: DataFrame, span: Span, width: float, low: float | None, high: float | None) -> DataFrame:
    """Rows repeated for the cells they touch, in ``_cell``, with the first of them in ``_first``.

    A window that ends before it begins touches the cells between. Times beyond ``low`` and ``high`` count as these, so
    infinite ones touch no more cells than there are. Rows without a time touch none and match nothing.
    """
    def cell(column: str) -> Column:
        tick = _tick(df, column)
        if low is not None and high is not None:
            tick = F.when(tick.isNotNull(), F.least(F.greatest(tick, F.lit(low)), F.lit(high)))
        return F.floor(tick / width)

    first = cell(span.start)
    if span.end is None:
        return df.withColumn("_first", first).where(F.col("_first").isNotNull()).withColumn("_cell", F.col("_first"))
    last = cell(span.end)
    there = df.withColumns({"_first": F.least(first, last), "_last": F.greatest(first, last)}).where(first.isNotNull() & last.isNotNull())
    # in two steps, as one window may touch very many cells
    start, end = (F.floor(F.col(c) / MANY) for c in ("_first", "_last"))
    there = there.withColumn("_many", F.explode(F.sequence(start, end)))
    begin, stop = F.greatest(F.col("_first"), F.col("_many") * MANY), F.least(F.col("_last"), F.col("_many") * MANY + MANY - 1)
    return there.withColumn("_cell", F.explode(F.sequence(begin, stop))).drop("_many", "_last")


def timed_cell_join(
    anchors: DataFrame,
    rows: DataFrame,
    on: Sequence[str],
    a: Span,
    r: Span,
    condition: Column,
    width: float | None = None,
) -> DataFrame:
    """Inner join on ``on``, a shared time cell, and ``condition``, which names the sides ``a`` and ``r`` and must not hold
    where the times of the two sides do not touch.

    ``width`` is the width of a cell; by default the mean length of the windows, which takes one pass over the sides
    that have windows. Times of different types are joined by key alone.
    """
    sides = [(anchors, a), (rows, r)]
    if not _comparable(sides):
        return timed_join(anchors, rows, on, condition)
    low = high = None
    if width is None or dict(anchors.dtypes)[a.start] not in TIMES:
        mean, low, high = measure(sides)
        width = width or mean
    if not width > 0:
        width = LEAST_WIDTH
    cut = [_in_cells(df, span, width, low, high).withColumn("_salt", _bucket(on)) for df, span in sides]
    # a pair that shares several cells is made in the first of them
    once = F.col("a._cell") == F.greatest("a._first", "r._first")
    extra = [c for c in rows.columns if c not in anchors.columns]
    left, right = cut[0].alias("a"), cut[1].alias("r")
    equal = reduce(Column.__and__, [F.col(f"a.{k}") == F.col(f"r.{k}") for k in [*on, "_cell", "_salt"]])
    return left.join(right, equal & once & condition, "inner").select(*[F.col(f"a.`{c}`") for c in anchors.columns], *[F.col(f"r.`{c}`") for c in extra])


def events_in_window(
    anchors: DataFrame,
    events: DataFrame,
    on: Sequence[str],
    ts: str,
    start: str | None,
    end: str,
    end_open: bool = False,
    salts: int = SALTS,
    width: float | None = None,
) -> DataFrame:
    """Events whose ``ts`` lies in the anchor's ``[start, end]``; both ends count.

    ``start=None`` leaves the window open to the past: nearly every event of the key then matches, so the join is by key.
    ``end_open`` excludes the upper end. ``width`` is that of a time cell; by default the mean length of the windows.
    """
    t = F.col(f"r.{ts}")
    upper = t < F.col(f"a.{end}") if end_open else t <= F.col(f"a.{end}")
    condition = upper if start is None else (t >= F.col(f"a.{start}")) & upper
    if start is None or salts > 1:
        return timed_join(anchors, events, on, condition, salts)
    return timed_cell_join(anchors, events, on, Span(start, end), Span(ts), condition, width)


def points_in_intervals(
    anchors: DataFrame,
    intervals: DataFrame,
    on: Sequence[str],
    point: str,
    start: str,
    end: str,
    salts: int = 1,
    width: float | None = None,
) -> DataFrame:
    """Intervals that contain the anchor's ``point``. An anchor may match several."""
    p = F.col(f"a.{point}")
    condition = p.between(F.col(f"r.{start}"), F.col(f"r.{end}"))
    if salts > 1:
        return timed_join(anchors, intervals, on, condition, salts)
    return timed_cell_join(anchors, intervals, on, Span(point), Span(start, end), condition, width)


def intervals_overlapping(
    anchors: DataFrame,
    intervals: DataFrame,
    on: Sequence[str],
    istart: str,
    iend: str,
    start: str,
    end: str,
    salts: int = SALTS,
    width: float | None = None,
) -> DataFrame:
    """Intervals ``[istart, iend]`` that touch the anchor's ``[start, end]``."""
    condition = (F.col(f"r.{iend}") >= F.col(f"a.{start}")) & (F.col(f"r.{istart}") <= F.col(f"a.{end}"))
    if salts > 1:
        return timed_join(anchors, intervals, on, condition, salts)
    return timed_cell_join(anchors, intervals, on, Span(start, end), Span(istart, iend), condition, width)


def sift(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key may be one of ``keys``: all that are, and about one in ``SIEVE_BITS`` of the others.

    Goes before a join, so that most rows without a partner are not shuffled. Tasks get a bitmap of hashes with ``SIEVE_BITS``
    bits for a key, in at most ``SIEVE_WORDS`` words; with still more keys, more of the others pass.
    """
    n = keys.agg(F.approx_count_distinct(on)).first()[0]
    words = min(SIEVE_WORDS, n * SIEVE_BITS // 64 + 1)

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumn("_hash", F.xxhash64(on)).withColumn("_word", F.pmod(F.shiftright("_hash", 6), F.lit(words)))

    bits = placed(keys.select(on)).groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, CAST(_hash & 63 AS INT)))").alias("_bits"))
    there = placed(rows).join(F.broadcast(bits), "_word").where("shiftright(_bits, CAST(_hash & 63 AS INT)) & 1 = 1")
    return there.select(*rows.columns)


def attach(spine: DataFrame, parts: Sequence[DataFrame], on: Sequence[str], fill: dict | None = None) -> DataFrame:
    """Left join of one-row-per-key parts onto a spine, all on the same key."""
    out = reduce(lambda left, part: left.join(part, list(on), "left"), parts, spine)
    return out.fillna(fill) if fill else out


def any_match(spine: DataFrame, matches: Sequence[DataFrame], on: Sequence[str], name: str) -> DataFrame:
    """0/1 flag: the key occurs in at least one of ``matches`` (an OR of EXISTS tests)."""
    keys = reduce(DataFrame.unionByName, [m.select(*on) for m in matches]).distinct()
    return attach(spine, [keys.withColumn(name, F.lit(1))], on, {name: 0})

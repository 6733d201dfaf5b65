"""Prefix tree of conversations: which beginnings are shared, by how many, and what sharing them saves.

Turns become ids, and a conversation becomes rows of ``WIDTH`` positional id columns. One ``ROLLUP`` over these columns
aggregates the prefixes of every length at once; ``grouping_id`` tells how long each is. A longer conversation goes on
in further rows, its column blocks, which are grouped by the node at which the block before ended as well. That node is
named by a 128-bit fingerprint of its whole prefix, so the blocks of all depths go through the same ROLLUP together,
and the number of jobs does not depend on the longest conversation.

Sums over subtrees need no walk up the tree. Every value of a node is booked on its smallest member, which is a member
of all nodes above too; what lies below a node is then a plain sum over its members, and a second ROLLUP gives it.

No step brings a whole conversation, or all members of a node, into one task: turns are numbered in sorted ranges,
totals along a conversation are taken in stretches of ``STRETCH`` blocks, and lists of members are joined to text in
pieces, of which one task only hashes the stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.session import settle

WIDTH = 8
STRETCH = 1024
PIECE = 8192
# Fixed value: what counts as a word of a turn
WORD = r"[^\x20\x09-\x0D]+"

Key = ["depth", "fp1", "fp2"]


def numbered(rows: DataFrame, key: str, order: Sequence[Column | str]) -> DataFrame:
    """``rows`` with ``pos``, from 1 in each ``key``, in the given order.

    The whole table is cut into sorted ranges, so the rows of one key may span many tasks; each range counts on its
    own, and the counts of earlier ranges of the same key are added. Rows that are equal in key and order are put in
    the order in which they are read.
    """
    rows = rows.withColumn("_read", F.monotonically_increasing_id())
    keys = [F.col(key), *[F.col(c) if isinstance(c, str) else c for c in order], F.col("_read")]
    placed = settle(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_seq", F.monotonically_increasing_id()))
    # the upper bits are the number of the range
    placed = placed.withColumn("_range", F.shiftright("_seq", 33))
    ranges = placed.groupBy(key, "_range").agg(F.min("_seq").alias("_low"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(key, "_range", "_low", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    pos = (F.col("_seq") - F.col("_low") + F.col("_before") + 1).cast("long")
    return placed.join(ranges, [key, "_range"]).withColumn("pos", pos).drop("_seq", "_range", "_low", "_before", "_read")


def turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, pos, turn_id)``: the turns of every conversation, numbered from 1 by ``turn``, null first.

    Equal role and text give equal ids and others different ones: 128 bits of a SHA-256 with the number of words behind
    them. Rows of one turn number are ordered by role and id. Rows without a conversation are left out; a null role or
    text is empty. Texts are read once and go no further than this step.
    """
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.substring(F.sha2(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t).cast("binary"), 256), 1, 32)
    rows = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), r.alias("role"),
        F.concat(digest, F.lit(":"), F.regexp_count(t, F.lit(WORD)).cast("string")).alias("turn_id"),
    )
    return numbered(rows, "conv_id", [F.asc_nulls_first("turn"), "role", "turn_id"]).select("conv_id", "pos", "turn_id")


def rebased(rows: DataFrame, step: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first one of their group of ``step`` ids: ``(turns, conversations)``.

    Conversation c takes its first h turns (h = crc32 of its id, modulo ``most``) from conversation c - c % step, all of
    them if it has fewer, none if it does not exist, and goes on with its own turns after its first h. The second
    table has a row per conversation, also where no turn is left, with its ``length``.
    """
    heads = rows.where(F.col("pos") < most).groupBy(F.col("conv_id").alias("_base")).agg(
        *[F.max(F.when(F.col("pos") == k, F.col("turn_id"))).alias(f"_h{k}") for k in range(1, most)], F.count(F.lit(1)).alias("_have")
    )
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_own")).withColumn("_h", h)
    convs = convs.withColumn("_base", F.col("conv_id") - F.col("conv_id") % step).join(heads, "_base", "left")
    taken = F.least(F.col("_h"), F.coalesce("_have", F.lit(0)))
    convs = settle(
        convs.withColumn("_taken", taken).withColumn("length", F.col("_taken") + F.greatest(F.col("_own") - F.col("_h"), F.lit(0)))
    )
    head = F.slice(F.array(*[F.col(f"_h{k}") for k in range(1, most)]), F.lit(1), F.col("_taken").cast("int"))
    begun = convs.select("conv_id", F.posexplode(head).alias("pos", "turn_id"))
    begun = begun.select("conv_id", (F.col("pos") + 1).cast("long").alias("pos"), "turn_id")
    own = rows.join(convs.select("conv_id", "_h", "_taken"), "conv_id").where(F.col("pos") > F.col("_h"))
    own = own.select("conv_id", (F.col("pos") - F.col("_h") + F.col("_taken")).alias("pos"), "turn_id")
    return begun.unionByName(own), convs.select("conv_id", "length")


def _ids() -> list[str]:
    return [f"t{j}" for j in range(WIDTH)]


def _mark(seed: int, used: Column | None = None) -> Column:
    """Fingerprint of the turns of a block (of the first ``used``): one hash per turn and position, combined by XOR."""
    parts = []
    for j, t in enumerate(_ids()):
        there = F.col(t).isNotNull() if used is None else F.col(t).isNotNull() & (F.lit(j) < used)
        one = F.xxhash64(F.lit(seed), F.col("block") * WIDTH + j, F.col(t))
        parts.append(F.when(there, one).otherwise(F.lit(0).cast("long")))
    return reduce(lambda a, b: a.bitwiseXOR(b), parts)


def _along(rows: DataFrame, totals: dict[str, tuple[str, object, bool]]) -> DataFrame:
    """Totals over the blocks of the same conversation before (or, where told, after) each block.

    ``totals`` maps a new name to (column, aggregate, backwards). Blocks are taken in stretches, and the stretches'
    own totals are added; conversations of one stretch, nearly all, have none to add.
    """
    rows = rows.withColumn("_s", F.floor(F.col("block") / STRETCH))
    carried = []
    for name, (column, agg, back) in totals.items():
        order = F.col("block").desc() if back else F.col("block")
        w = Window.partitionBy("conv_id", "_s").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn(name, F.coalesce(agg(column).over(w), F.lit(0).cast("long")))
        order = F.col("_s").desc() if back else F.col("_s")
        w = Window.partitionBy("conv_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        carried.append((name, column, agg, w))
    long = rows.where(F.col("last") >= STRETCH).groupBy("conv_id", "_s").agg(*[agg(c).alias(f"_t{n}") for n, c, agg, _ in carried])
    long = long.select("conv_id", "_s", *[agg(f"_t{n}").over(w).alias(f"_c{n}") for n, _, agg, w in carried])
    rows = rows.join(long, ["conv_id", "_s"], "left")
    for name, _, agg, _ in carried:
        more = F.coalesce(F.col(f"_c{name}"), F.lit(0).cast("long"))
        rows = rows.withColumn(name, F.col(name).bitwiseXOR(more) if agg is F.bit_xor else F.col(name) + more)
    return rows.drop("_s", *[f"_c{n}" for n in totals])


def _rollup(blocks: DataFrame, sums: Sequence[str] = ()) -> DataFrame:
    """One row per node: all prefixes inside the column blocks, by one ROLLUP."""
    ids = ", ".join(_ids())
    more = "".join(f", sum({c}) AS {c}" for c in sums)
    found = blocks.sparkSession.sql(
        f"""SELECT block, key1, key2, {ids}, CAST(grouping_id() AS BIGINT) AS g, count(*) AS n_convs, min(conv_id) AS conv_id,
            max(length) AS longest{more} FROM {{blocks}} GROUP BY block, key1, key2, ROLLUP({ids})""",
        blocks=blocks,
    )
    # the d columns that are kept leave WIDTH - d ones in the grouping id
    level = F.lit(WIDTH) - F.length(F.regexp_replace(F.conv(F.col("g").cast("string"), 10, 2), "0", ""))
    found = found.withColumn("level", level.cast("long"))
    last = F.element_at(F.array(*_ids()), F.greatest(F.col("level"), F.lit(1)).cast("int"))
    # the top of a later block is the end of the block before; columns beyond the end of a conversation are no turns
    found = found.withColumn("turn_id", F.when(F.col("level") > 0, last)).where(F.when(F.col("level") == 0, F.col("block") == 0).otherwise(last.isNotNull()))
    return found.select(
        "conv_id", (F.col("block") * WIDTH + F.col("level")).alias("depth"), "level", "turn_id", "n_convs",
        (F.col("longest") == F.col("block") * WIDTH + F.col("level")).alias("leaf"),
        *[F.col(k).bitwiseXOR(_mark(s, F.col("level"))).alias(f"fp{s}") for s, k in ((1, "key1"), (2, "key2"))],
        *[F.col(k).bitwiseXOR(_mark(s, F.col("level") - 1)).alias(f"up{s}") for s, k in ((1, "key1"), (2, "key2"))],
        *sums,
    )


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of one node, in order, as comma-joined text of at most ``PIECE`` ids."""
    now: tuple | None = None
    ids: list[int] = []

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {"depth": [now[0]], "fp1": [now[1]], "fp2": [now[2]], "first": [ids[0]], "ids": [",".join(map(str, ids))]}, PIECES
        )

    for batch in batches:
        for *node, one in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if ids and (tuple(node) != now or len(ids) >= PIECE):
                yield piece()
                ids = []
            now = tuple(node)
            ids.append(one)
    if ids:
        yield piece()


PIECES = pa.schema([("depth", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
HASHED = pa.schema([("depth", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("ends_sha256", pa.string())])


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces in order; holds one running hash."""
    now, state = None, None
    for batch in batches:
        out = []
        for *node, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if tuple(node) != now:
                if now is not None:
                    out.append((*now, state.hexdigest()))
                now, state = tuple(node), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], schema=HASHED)
    if now is not None:
        yield pa.RecordBatch.from_pydict({n: [v] for n, v in zip(HASHED.names, (*now, state.hexdigest()), strict=True)}, HASHED)


def end_hashes(ends: DataFrame) -> DataFrame:
    """``(depth, fp1, fp2, ends_sha256)`` of rows ``(depth, fp1, fp2, conv_id)``: the ids of a node, ascending, comma-joined.

    Ids are sorted and joined in ranges; the hash itself is sequential, so one task reads a node's text as a stream.
    """
    order = [*Key, "conv_id"]
    ranges = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = ranges.mapInArrow(_pieces, "depth long, fp1 long, fp2 long, first long, ids string")
    return pieces.repartition(*Key).sortWithinPartitions(*Key, "first").mapInArrow(_hash_pieces, "depth long, fp1 long, fp2 long, ends_sha256 string")


def trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """The prefix tree of turns ``(conv_id, pos, turn_id)`` and conversations ``(conv_id, length)``.

    One row per node, from the root of depth 0, which all conversations share, to the ends: ``conv_id`` (smallest
    member, which with ``depth`` names the node), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` (over the subtree, words that need not be repeated), ``ends_sha256``
    (of the ids of those that end here), and ``turn_id`` of the last turn (null for the root). No conversations give no
    nodes. Other columns of either table are not read.
    """
    rows = rows.select("conv_id", "pos", "turn_id").withColumn("block", F.floor((F.col("pos") - 1) / WIDTH))
    slot = (F.col("pos") - 1) % WIDTH
    filled = [F.max(F.when(slot == j, F.col("turn_id"))).alias(t) for j, t in enumerate(_ids())]
    blocks = rows.groupBy("conv_id", "block").agg(*filled).join(convs.select("conv_id", "length"), "conv_id")
    # a conversation without turns is a member of the root
    empty = convs.where(F.col("length") == 0).select("conv_id", F.lit(0).cast("long").alias("block"), *[F.lit(None).cast("string").alias(t) for t in _ids()], "length")
    blocks = blocks.unionByName(empty).withColumns({"last": F.floor(F.greatest(F.col("length") - 1, F.lit(0)) / WIDTH), "x1": _mark(1), "x2": _mark(2)})
    blocks = settle(_along(blocks, {"key1": ("x1", F.bit_xor, False), "key2": ("x2", F.bit_xor, False)}))

    nodes = _rollup(blocks)
    words = F.coalesce(F.split_part("turn_id", F.lit(":"), F.lit(2)), F.lit("0")).cast("long")
    nodes = settle(nodes.select("conv_id", "depth", "level", "leaf", ((F.col("n_convs") - 1) * words).alias("saved")))
    # values of nodes, booked on their smallest member
    saved = nodes.where((F.col("saved") > 0)).withColumn("block", F.floor((F.col("depth") - 1) / WIDTH))
    booked = [F.sum(F.when(F.col("level") == j + 1, F.col("saved"))).alias(f"v{j}") for j in range(WIDTH)]
    saved = saved.groupBy("conv_id", "block").agg(*booked)
    leaves = nodes.where("leaf").select("conv_id", F.lit(1).cast("long").alias("n_leaves"))
    value = [F.coalesce(F.col(f"v{j}"), F.lit(0)).cast("long") for j in range(WIDTH)]
    tails = {f"s{j}": reduce(Column.__add__, value[j:]) for j in range(WIDTH)}
    full = blocks.join(saved, ["conv_id", "block"], "left").join(leaves, "conv_id", "left").withColumns(tails)
    full = _along(full, {"later": ("s0", F.sum, True)})
    full = full.withColumns({f"s{j}": F.col(f"s{j}") + F.col("later") for j in range(WIDTH)})
    full = full.withColumn("n_leaves", F.coalesce("n_leaves", F.lit(0).cast("long")))
    sums = [f"s{j}" for j in range(WIDTH)]
    found = _rollup(full.select("conv_id", "block", "key1", "key2", *_ids(), "length", "n_leaves", *sums), ["n_leaves", *sums])
    below = F.element_at(F.array(*sums), F.greatest(F.col("level"), F.lit(1)).cast("int"))
    found = settle(found.withColumn("saved_tokens", below).drop(*sums, "level"))

    above = found.where(F.col("depth") > 0).groupBy((F.col("depth") - 1).alias("depth"), F.col("up1").alias("fp1"), F.col("up2").alias("fp2"))
    children = above.agg(F.count(F.lit(1)).alias("n_children"))
    ends = blocks.where(F.col("block") == F.col("last")).select(
        F.col("length").alias("depth"), F.col("key1").bitwiseXOR(F.col("x1")).alias("fp1"), F.col("key2").bitwiseXOR(F.col("x2")).alias("fp2"), "conv_id"
    )
    hashed = settle(end_hashes(ends))
    # all nodes of depth 1 have the root above them: one number, and the join below need not deal with so many children
    root = found.where(F.col("depth") == 0).select("conv_id").first()
    parents = found.where(F.col("depth") > 0).select(
        (F.col("depth") + 1).alias("depth"), F.col("fp1").alias("up1"), F.col("fp2").alias("up2"), F.col("conv_id").alias("_parent")
    )
    deep = found.join(parents, ["depth", "up1", "up2"], "left")
    parent = F.when(F.col("depth") == 1, F.lit(root["conv_id"] if root else None).cast("long")).otherwise(F.col("_parent"))
    nothing = hashlib.sha256(b"").hexdigest()
    return (
        deep.join(children, Key, "left").join(hashed, Key, "left")
        .select(
            "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
            "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"), "turn_id",
        )
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """:func:`trie` of a table ``(conv_id, turn, role, text)`` as it stands."""
    rows = turns(conversations)
    return trie(rows, rows.groupBy("conv_id").agg(F.max("pos").alias("length")))

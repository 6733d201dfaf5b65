"""Jaccard join of documents on word shingles with a forest of signature trees.

Documents with equal sets of shingles are one class. Classes whose similarity can reach the threshold differ in at most
D shingles, where D follows from their sizes; so when the shingle space is cut by hash into more than D parts, they
agree completely on some part. Each (size range, part, content of the part) is the root of one signature tree, which
holds the classes that agree there, and every linked pair meets below some root. Nodes of a tree hold the OR of their
members' shingle bitmaps and their range of sizes. Of the roots that a class can do without, the most frequent ones are
left out, as in prefix filtering. Traversing a tree against itself, pairs of nodes are dropped when
the largest overlap they allow is too small, or when all their members are known to be connected. What is left is
verified on the complete sets.

Trees with the same members are one. To find components, some rounds first propose, for every member, a few neighbours in
leaf order whose bounds allow a link; what they connect is one component, and the complete traversal afterwards only
looks at pairs of different components.

Rows: null and empty texts have no shingles and link with nothing; texts shorter than a shingle are one shingle as a
whole. Repeated rows and repeated ids are judged by their text. Rows without id come last and show a null component
id only if all of the component lack one. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.llm.text import FOLDED, SMALL_BATCH, U64, chunks, known, mix, prefix_hash, release, row_of, rows_with, shingles, shown, span_hash, words
from cohortflow.session import scratch, settle, shared_dir

RANGE = 1.6  # ratio of the largest to the smallest size of a range
SPARE = 0.04  # share of parts beyond D + 1, as some stay empty
SEEDS = 6
BITS = 1024
FAN = 16
PAIRS_AT_ONCE = 2048
PROPOSED = 3  # neighbours of each member in a round of proposals, of the next REACH in leaf order
REACH = 64
ROUNDS = 2
BROADCAST_IDS = 500_000

PAIRS = "a long, b long"


def sets_of(buf: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every row, sorted within the row, and how many each row has."""
    start, end, begin = words(buf, off)
    h = span_hash(prefix_hash(buf, FOLDED), start, end)
    grams, row = shingles(h, begin, n)
    edge = np.searchsorted(row, np.arange(len(off)))
    own = [np.unique(grams[a:b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
    size = np.fromiter(map(len, own), np.int64, len(own))
    return (np.concatenate(own) if own else np.zeros(0, U64)), size


def _row_sums(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values, out=total[1:])
    end = np.cumsum(size)
    return total[end] - total[end - size]


def set_ids(grams: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """One number for each set, the same for equal sets."""
    return mix(_row_sums(mix(grams + U64(2 * seed + 1)), size) + size.astype(U64)).astype(np.int64)


def bitmaps(grams: np.ndarray, size: np.ndarray) -> np.ndarray:
    bits = np.zeros((len(size), BITS), bool)
    bits[row_of(size), (grams >> U64(54)).astype(np.int64) % BITS] = True
    return np.packbits(bits, axis=1).view(U64)


class Ranges:
    """Size ranges, and for each the largest difference of a linked pair and the number of parts."""

    def __init__(self, percent: int, largest: int):
        self.percent = percent
        low = [1]
        while low[-1] <= largest * 2:
            low.append(int(low[-1] * RANGE) + 1)
        self.low = np.array(low)
        self.high = np.append(self.low[1:], 2 * self.low[-1]) - 1
        most = 2 * self.high * (100 - percent) // (100 + percent)
        self.parts = most + 1 + np.where(most > 0, np.ceil(SPARE * most).astype(np.int64), 0)

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, size, "right") - 1

    def also_next(self, size: np.ndarray) -> np.ndarray:
        """Whether a partner may lie in the next range up."""
        return 100 * size >= self.percent * self.low[self.of(size) + 1]

    def difference(self, size: np.ndarray, which: np.ndarray) -> np.ndarray:
        partner = np.minimum(self.high[which], 100 * size // self.percent)
        return (size + partner) * (100 - self.percent) // (100 + self.percent)


def root_keys(grams: np.ndarray, size: np.ndarray, ranges: Ranges) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the trees that each set belongs to, with the set's row, the cut (range and seed) that the key comes from,
    and how many keys of that cut the set can do without: it shares one more than these with every linked set.

    A pair is sure to agree on a part that is not empty if either of the two fills more than D parts. Sets that don't
    (several shingles fell into one part) are cut again with another seed; after the last seed their empty parts
    count too. So any linked pair meets under the first seed that suffices for one of the two.
    """
    out, rows, cuts, spare = [], [], [], []
    begin = np.cumsum(size) - size
    for up in (0, 1):
        left = np.flatnonzero(size > 0)
        if up:
            left = left[ranges.also_next(size[left])]
        for seed in range(SEEDS + 1):
            if not len(left):
                break
            n = size[left]
            which = ranges.of(n) + up
            parts = ranges.parts[which]
            salt = mix(which.astype(U64) * U64(64) + U64(seed + 1))
            row = row_of(n)
            g = grams[np.repeat(begin[left] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            part = ((mix(g ^ salt[row]) >> U64(32)) * parts[row].astype(U64)) >> U64(32)
            base = np.cumsum(parts) - parts
            cell = base[row] + part.astype(np.int64)
            filled = np.bincount(cell, minlength=int(parts.sum())) > 0
            sums = np.zeros(int(parts.sum()), U64)
            np.add.at(sums, cell, mix(g + U64(0x51ED)))
            owner = row_of(parts)
            differ = ranges.difference(n, which)
            parts_filled = np.add.reduceat(filled, base, dtype=np.int64)
            enough = parts_filled > differ
            show = filled | (~enough[owner] if seed == SEEDS else False)
            place = np.flatnonzero(show)
            cuts.append(((which * (SEEDS + 1) + seed) * 2 + up)[owner[place]])
            # of a set with too few filled parts for the cut, the other one's parts decide
            spare.append(np.where(enough, parts_filled - differ - 1, 0)[owner[place]])
            out.append(mix(sums[place] + mix(salt[owner[place]] + (place - base[owner[place]]).astype(U64))))
            rows.append(left[owner[place]])
            left = left[~enough]
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return np.concatenate(out).astype(np.int64), np.concatenate(rows), np.concatenate(cuts), np.concatenate(spare)


def _needed(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of linked sets of these sizes."""
    return -(-percent * (x + y) // (100 + percent))


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(-1, dtype=np.int64)


class SignatureTree:
    """Members ordered by size, ``FAN`` below each node; level 0 are the members."""

    def __init__(self, size: np.ndarray, signs: np.ndarray, component: np.ndarray):
        # sizes may only shrink upwards to a range: every node has low and high, the OR and the fewest bits of a member
        self.levels = [(size, size, signs, _bits(signs), component)]
        while len(self.levels[-1][0]) > 1:
            low, high, own, fewest, same = self.levels[-1]
            first = np.arange(0, len(low), FAN)
            alike = np.minimum.reduceat(same, first) == np.maximum.reduceat(same, first)
            self.levels.append((
                np.minimum.reduceat(low, first), np.maximum.reduceat(high, first), np.bitwise_or.reduceat(own, first, axis=0),
                np.minimum.reduceat(fewest, first), np.where(alike, same[first], -1 - np.arange(len(first))),
            ))

    def may_link(self, level: int, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Node pairs that the largest possible overlap and the components leave open."""
        low, high, signs, fewest, same = self.levels[level]
        shared = _bits(signs[i] & signs[j])
        # a member has as many shingles outside the other node as it has bits there
        most = np.minimum(high[i] - np.maximum(fewest[i] - shared, 0), high[j] - np.maximum(fewest[j] - shared, 0))
        fits = most >= _needed(low[i], low[j], percent)
        fits &= (100 * high[i] >= percent * low[j]) & (100 * high[j] >= percent * low[i])
        return fits & ~((same[i] == same[j]) & (same[i] >= 0))

    def pairs(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Dual traversal from the root pair; yields pairs of members."""
        top = len(self.levels) - 1
        stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, i, j = stack.pop()
            if level:
                keep = self.may_link(level, i, j, percent) if level < top else np.ones(len(i), bool)
                keep |= (i == j) & (self.levels[level][4][i] < 0)
            else:
                keep = (i != j) & self.may_link(0, i, j, percent)
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            if not level:
                yield i, j
                continue
            below = len(self.levels[level - 1][0])
            for k in range(0, len(i), PAIRS_AT_ONCE):
                a = i[k : k + PAIRS_AT_ONCE, None, None] * FAN + np.arange(FAN)[:, None]
                b = j[k : k + PAIRS_AT_ONCE, None, None] * FAN + np.arange(FAN)
                a, b = (x.ravel() for x in np.broadcast_arrays(a, b))
                real = (a < below) & (b < below) & (a <= b)
                stack.append((level - 1, a[real], b[real]))


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of a partition sorted by the first column, cut such that no group is torn."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if cut == 0 and held and held[-1].column(0)[0].as_py() == key[-1]:
            held.append(batch)
            continue
        held.append(batch.slice(0, cut))
        yield pa.Table.from_batches(held)
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def _traverse(percent: int, propose: bool):
    """For ``mapInArrow`` on (tree, size, sid, signs, component), sorted by tree and size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches):
            if not t.num_rows:
                continue
            tree, size, sid, component = (t[c].to_numpy() for c in ("tree", "size", "sid", "component"))
            component = np.unique(component, return_inverse=True)[1]  # negative numbers mark mixed nodes
            signs = np.frombuffer(b"".join(t["signs"].to_pylist()), U64).reshape(len(sid), BITS // 64)
            first = np.flatnonzero(np.concatenate([[True], tree[1:] != tree[:-1]]))
            count = np.diff(np.append(first, len(tree)))
            flat = SignatureTree.__new__(SignatureTree)
            flat.levels = [(size, size, signs, _bits(signs), component)]
            found = []
            if propose:
                has = np.zeros(len(tree), np.int64)
                for k in range(1, min(REACH + 1, len(tree))):
                    i = np.flatnonzero((tree[k:] == tree[:-k]) & (has[:-k] < PROPOSED))
                    i = i[flat.may_link(0, i, i + k, percent)]
                    has[i] += 1
                    found.append((i, i + k))
            else:
                small = np.repeat(count <= FAN, count)
                for k in range(1, min(FAN, len(tree))):
                    i = np.flatnonzero((tree[k:] == tree[:-k]) & small[k:])
                    found.append((i + k, i))
                i, j = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else ((), ())))
                open_ = flat.may_link(0, i, j, percent)
                found = [(i[open_], j[open_])]
                for k in np.flatnonzero(count > FAN):
                    own = slice(first[k], first[k] + count[k])
                    for a, b in SignatureTree(size[own], signs[own], component[own]).pairs(percent):
                        yield _pairs(sid[own][a], sid[own][b])
            for a, b in found:
                yield _pairs(sid[a], sid[b])

    return run


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)``: the smallest node reachable by links, for every node that has one.

    Labels fall to the least of the neighbours' and then jump to the label's label, until none changes; every round is
    settled.
    """
    edges = settle(links.select(F.col(a).alias("u"), F.col(b).alias("v")).union(links.select(b, a)).distinct())
    labels = settle(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).select(F.col("u").alias("node"), "label"))
    while True:
        seen = edges.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("low"))
        lower = labels.join(seen, labels["node"] == seen["u"]).select("node", F.col("label").alias("old"), F.least("label", "low").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = settle(lower.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")))
        labels = new.select("node", "label")
        if not new.where(F.col("label") != F.col("old")).limit(1).count():
            return labels.withColumnRenamed("label", "component")


class Join:
    """The join of one table; the steps are settled as they are needed."""

    def __init__(self, docs: DataFrame, percent: int, n: int, key: str = "doc_id", text: str = "text"):
        self.docs, self.percent, self.n = rows_with(docs, key, text, size=SMALL_BATCH).withColumn("doc_id", known()), percent, n
        self.seed, self.rows = 0, None
        while self.rows is None:
            rows = settle(self._described(self.seed))
            # another seed if two different sets should have one number
            clash = rows.where("size > 0").groupBy("sid").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).where("lo <> hi")
            if clash.limit(1).count():
                self.seed += 1
            else:
                self.rows = rows
        self.classes = settle(
            self.rows.where("size > 0").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("signs").alias("signs"))
        )
        self.largest = self.classes.agg(F.max("size")).first()[0] or 0

    def _described(self, seed: int) -> DataFrame:
        n = self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows, buf, off in chunks(batch):
                    grams, size = sets_of(buf, off, n)
                    signs = [s.tobytes() for s in bitmaps(grams, size)]
                    yield pa.RecordBatch.from_arrays(
                        [rows.column(0), pa.array(size), pa.array(set_ids(grams, size, seed)), pa.array(set_ids(grams, size, seed + 1000)), pa.array(signs, pa.binary())],
                        names=["doc_id", "size", "sid", "other", "signs"],
                    )
            release()

        return self.docs.mapInArrow(run, "doc_id long, size long, sid long, other long, signs binary")

    def _roots(self) -> DataFrame:
        """``(root, sid, cut, spare)`` of all trees; a copy within a batch counts once."""
        n, seed, ranges = self.n, self.seed, Ranges(self.percent, self.largest)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, buf, off in chunks(batch):
                    grams, size = sets_of(buf, off, n)
                    sid = set_ids(grams, size, seed)
                    once = np.zeros(len(sid), bool)
                    once[np.unique(sid, return_index=True)[1]] = True
                    grams, size, sid = grams[once[row_of(size)]], size[once], sid[once]
                    root, row, cut, spare = root_keys(grams, size, ranges)
                    yield pa.RecordBatch.from_arrays([pa.array(root), pa.array(sid[row]), pa.array(cut, pa.int32()), pa.array(spare, pa.int32())], names=["root", "sid", "cut", "spare"])
            release()

        return self.docs.mapInArrow(run, "root long, sid long, cut int, spare int")

    def trees(self) -> DataFrame:
        """``(tree, sid, members)`` of the trees with two members or more; of equal trees one.

        A class that shares all but D of its roots with every linked one need not stand below all of them: leaving out
        its most frequent roots, as many as it can do without, any linked pair still meets below one of the rest. Roots
        that no other class has count among the rest, so a class that shares only a passage with others stands below
        none.

        The roots are by far the largest table here: they are shuffled once, and only those that several classes share
        are written.
        """
        held = self._roots().repartition("root").dropDuplicates(["root", "sid"])
        own = Window.partitionBy("root")
        shared = settle(held.select("root", "sid", "cut", "spare", F.count("*").over(own).alias("members")).where("members > 1"))
        # a class has no more roots of a cut than parts
        frequent = Window.partitionBy("sid", "cut").orderBy(F.desc("members"), F.desc("root"))
        rest = shared.withColumn("nth", F.row_number().over(frequent)).where(F.col("nth") > F.col("spare")).select("root", "sid")
        rest = settle(
            rest.select(
                "root", "sid", F.count("*").over(own).alias("members"),
                F.bit_xor(F.xxhash64("sid")).over(own).alias("x"), F.bit_xor(F.xxhash64("sid", F.lit(1))).over(own).alias("y"),
            ).where("members > 1")
        )
        kept = rest.groupBy("members", "x", "y").agg(F.min("root").alias("root"))
        return rest.join(kept.select("root"), "root", "left_semi").select(F.col("root").alias("tree"), "sid", "members")

    def _candidates(self, members: DataFrame, propose: bool) -> DataFrame:
        """Pairs of classes that the trees leave open. ``members``: (tree, sid, component)."""
        full = members.join(self.classes.select("sid", "size", "signs"), "sid").select("tree", "size", "sid", "signs", "component")
        return full.repartition("tree").sortWithinPartitions("tree", "size", "sid").mapInArrow(_traverse(self.percent, propose), PAIRS).distinct()

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs that reach the threshold on their complete sets."""
        n, percent = self.n, self.percent
        wanted = settle(pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct().join(self.classes.select("sid", "doc_id"), "sid"))
        few = wanted.count() <= BROADCAST_IDS
        ids = wanted.select("doc_id").distinct()
        docs = self.docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
        seed = self.seed

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, buf, off in chunks(batch):
                    grams, size = sets_of(buf, off, n)
                    own = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(grams.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(set_ids(grams, size, seed)), own], names=["sid", "grams"])
            release()

        # rows that share an id may have other texts
        found = settle(docs.mapInArrow(sets, "sid long, grams array<long>").join(wanted.select("sid"), "sid", "left_semi").dropDuplicates(["sid"]))
        x, y = found.toDF("a", "x"), found.toDF("b", "y")
        # a pair at a time: sets of very long texts never meet in one batch
        both = F.size(F.array_intersect("x", "y"))
        linked = both * 100 >= F.lit(percent) * (F.size("x") + F.size("y") - both)
        return pairs.join(x, "a").join(y, "b").where(linked).select("a", "b")

    def links(self) -> DataFrame:
        """All pairs ``(a, b)`` of linked classes, by their numbers."""
        members = self.trees().withColumn("component", F.col("sid"))
        return self.verified(settle(self._candidates(members, propose=False)))

    def connected(self) -> DataFrame:
        """``(sid, component)`` of the classes that have a link."""
        trees = settle(self.trees())
        own = trees.groupBy("sid").agg(F.max(F.struct("members", "tree")).alias("best")).select("sid", "best.tree")
        members = own.withColumn("component", F.col("sid"))
        links = settle(self.verified(settle(self._candidates(members, propose=True))))
        for turn in range(1, ROUNDS + 1):
            labels = components(links).withColumnRenamed("node", "sid")
            members = trees.join(labels, "sid", "left").select("tree", "sid", F.coalesce("component", "sid").alias("component"))
            open_ = members.groupBy("tree").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
            members = members.join(open_.select("tree"), "tree", "left_semi")
            # the last round is the complete traversal
            links = settle(links.union(self.verified(settle(self._candidates(members, propose=turn < ROUNDS)))))
        return components(links).withColumnRenamed("node", "sid")


def near_duplicates(docs: DataFrame, percent: int = 80, n: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row: the smallest id reachable by links.

    Two documents link when their sets of ``n``-word shingles have a Jaccard similarity of ``percent`` hundredths or more.
    """
    join = Join(docs, percent, n, key, text)
    ends = join.classes.select("sid", "doc_id").join(join.connected(), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    least = ends.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    known_as = ends.join(least, "component").select("sid", "component_id")
    rows = join.rows.select("doc_id", "size", F.when(F.col("size") > 0, F.col("sid")).alias("sid"))
    out = rows.join(known_as, "sid", "left")
    return out.select(
        shown().alias("doc_id"), F.col("size").alias("n_shingles"), shown(F.coalesce("component_id", "doc_id")).alias("component_id")
    )


def one_of_each(docs: DataFrame, percent: int = 80, n: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with the smallest id of their component, as they are and with all their columns.

    Rows that share an id stay or go together, except that of equal rows one stays; rows without id never go.
    """
    place = shared_dir(docs.sparkSession)
    with scratch(docs.sparkSession):  # the tables of the join go as soon as its result is there
        groups = near_duplicates(docs, percent, n, key, text).where("doc_id IS NOT NULL AND component_id <> doc_id")
        gone = settle(groups.select(F.col("doc_id").alias(key)).distinct(), place)
    few = gone.count() <= BROADCAST_IDS
    out = docs.join(F.broadcast(gone) if few else gone, key, "left_anti").select(docs.columns)
    repeated = settle(docs.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key))
    if not repeated.limit(1).count():
        return out
    return out.join(repeated, key, "left_anti").select(docs.columns).unionByName(
        out.join(repeated, key, "left_semi").select(docs.columns).dropDuplicates()
    )

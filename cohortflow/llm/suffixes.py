"""Removal of byte passages that an earlier document already has, with a logarithmic family of sorted suffix indexes.

A byte goes when a 50-byte string that covers it also starts in a document with a smaller id. Suffixes are told apart by
their first 50 bytes, so a suffix array here is a sorted array of such keys. Every batch of documents gets one, which is
merge-scanned against the levels that are there, and levels of like size are merged, so n batches make log n levels.

Two things keep this within bounds. Suffixes are dealt to many families by the smallest hash of their 16-byte substrings
(equal suffixes meet in one family), and consecutive suffixes with the same smallest hash travel as one run. A first
family works on runs as wholes: a run that an earlier document has too is removed as it is, and of the rest only
runs whose smallest hash also occurs with other content send their bytes to the second family, which works on single
suffixes. Of equal keys a level holds those of the smallest document only, so repeats of any number shrink to one. Where
one smallest hash has very many contents (a passage that many documents embed in texts of their own), suffixes are
first reduced to one per block and then dealt by their own hash, so that no family gets them all.

Documents are first written in compressed blocks to the shared folder; a block is a batch, and results come back to it.

Rows: null and empty texts have nothing to remove. Rows with the same id are judged apart and never against each other.
Rows without id come last. An empty table gives no rows. Columns named in ``carry`` pass through, under any name; others are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortflow.llm.text import LAST_ID, SMALL_BATCH, U64, bound_batches, chunks, known, prefix_hash, release, rows_with, span_hash
from cohortflow.session import scratch, settle, shared_dir

LENGTH = 50
GRAM = 16
LONGEST_RUN = 35
FAMILY_BYTES = 16 << 20  # text for each family
FAMILY_SUFFIXES = 1 << 19  # open suffixes for each family of the second kind
BATCH_SUFFIXES = 1 << 16  # of which so many at least are sorted and scanned at once
SEGMENT = 1 << 17  # suffixes hashed at once
MANY_CONTENTS = 256  # from which on the suffixes of one smallest hash are dealt singly

BLOCKS = "block long, ids binary, sizes binary, data binary, more binary"
TO_FAMILY = "family int, first long, block long, payload binary"
TO_BLOCK = "block long, family int, payload binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one byte string; dtypes are agreed on by ``unpack``."""
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64)
    return head.tobytes() + b"".join(a.tobytes() for a in arrays)


def unpack(raw: bytes, *kinds: str) -> list[np.ndarray]:
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    size = np.frombuffer(raw, np.int64, n, 8).tolist()
    at, out = 8 * (n + 1), []
    for kind, length in zip(kinds, size, strict=True):
        out.append(np.frombuffer(raw, kind, length // np.dtype(kind).itemsize, at))
        at += length
    return out


def narrow(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, what each value is above it in as few bytes as hold the largest); ``widen`` undoes it."""
    base = values.min(keepdims=True) if len(values) else np.zeros(1, np.int64)
    above = values.view(U64) - base.view(U64)  # beyond the signed range too
    return base, above.astype(np.min_scalar_type(above.max()) if len(above) else np.uint8)


def widen(base: np.ndarray, raw: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values of :func:`narrow`, from the bytes."""
    above = raw.view(f"u{len(raw) // n}").astype(U64) if n else np.zeros(0, U64)
    return (above + base.view(U64)).view(np.int64)


class Family:
    """Levels of sorted (key, document) entries; ``covered`` marks, batch by batch, entries that a smaller document has."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # keys, documents, batch, place
        self.covered: list[np.ndarray] = []

    def add(self, keys: np.ndarray, docs: np.ndarray) -> None:
        """Sort a batch, scan it against all levels, keep it as a level and merge levels of like size."""
        covered = np.zeros(len(keys), bool)
        self.covered.append(covered)
        if not len(keys):
            return
        order = np.argsort(docs, kind="stable")
        order = order[np.argsort(keys[order], kind="stable")]
        k, d = keys[order], docs[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        least = np.repeat(d[first], np.diff(np.append(first, len(k))))
        covered[order[d > least]] = True
        keep = d == least
        k, d, order = k[keep], d[keep], order[keep]
        for n, (lk, ld, lb, lp) in enumerate(self.levels):
            at = np.minimum(np.searchsorted(lk, k), len(lk) - 1)
            same = lk[at] == k
            late = same & (ld[at] < d)
            early = same & (ld[at] > d)
            if early.any():
                gone = np.zeros(len(lk), bool)
                for a, b in zip(np.searchsorted(lk, k[early]).tolist(), np.searchsorted(lk, k[early], "right").tolist(), strict=True):
                    gone[a:b] = True
                for b in np.unique(lb[gone]):
                    self.covered[b][lp[gone & (lb == b)]] = True
                self.levels[n] = tuple(x[~gone] for x in (lk, ld, lb, lp))
            if late.any():
                covered[order[late]] = True
                k, d, order = k[~late], d[~late], order[~late]
        self.levels = [x for x in self.levels if len(x[0])]
        if len(k):
            self.levels.append((k, d, np.full(len(k), len(self.covered) - 1, np.int32), order.astype(np.int32)))
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            self._merge()

    def _merge(self) -> None:
        """The last two levels become one, a column at a time, so that no more than one column is there twice."""
        one, two = list(self.levels.pop(-2)), list(self.levels.pop())
        later = np.searchsorted(one[0], two[0], "right") + np.arange(len(two[0]))
        first = np.ones(len(one[0]) + len(two[0]), bool)
        first[later] = False
        out = []
        while one:
            x, y = one.pop(0), two.pop(0)
            out.append(np.empty(len(first), x.dtype))
            out[-1][first] = x
            out[-1][later] = y
            del x, y
        self.levels.append(tuple(out))

    def rest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, batches and places of all entries, in no order; the levels go."""
        columns = [np.concatenate([x[c] for x in self.levels]) for c in (0, 2, 3)]
        self.levels = []
        return tuple(columns)


def suffix_runs(buf: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of consecutive suffixes with one smallest hash: (hash, content hash, first suffix, suffixes), piece by piece.

    Suffixes shorter than ``length`` are none. How runs are cut does not matter for the result, only that equal
    suffixes have equal smallest hashes.
    """
    for a in range(0, max(len(buf) - length + 1, 0), SEGMENT):
        part = buf[a : a + SEGMENT + length - 1]
        n = len(part) - length + 1
        prefix = prefix_hash(part)
        at = np.arange(len(part) - gram + 1)
        low = span_hash(prefix, at, at + gram)
        wide, span = length - gram + 1, 1
        while 2 * span <= wide:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < wide:
            low = np.minimum(low[: len(low) - (wide - span)], low[wide - span :])
        row = np.searchsorted(off, np.arange(a, a + n), "right") - 1
        inside = np.arange(a, a + n) + length <= off[row + 1]
        change = np.ones(n, bool)
        change[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1])
        begin = np.flatnonzero(change)
        since = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
        start = np.flatnonzero(inside & (since % LONGEST_RUN == 0))
        # a run ends where the next begins, or where the row has too few bytes left
        count = np.minimum(np.append(np.flatnonzero(change | (since % LONGEST_RUN == 0)), n)[1:], n)
        count = count[np.searchsorted(np.flatnonzero(change | (since % LONGEST_RUN == 0)), start)] - start
        last = off[row[start] + 1] - length - a
        count = np.minimum(count, last - start + 1)
        yield low[start], span_hash(prefix, start, start + count + length - 1), start + a, count, row[start]


class Blocks:
    """Documents in compressed blocks, and the texts of one block."""

    def __init__(self, ids: bytes, sizes: bytes, data: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        size = np.frombuffer(sizes, np.int64)
        self.off = np.concatenate([[0], np.cumsum(size)])
        total = int(self.off[-1])
        self.buf = np.frombuffer(pa.decompress(data, decompressed_size=total, codec="zstd", asbytes=True), np.uint8) if total else np.zeros(0, np.uint8)

    def runs(self, length: int) -> tuple[np.ndarray, ...]:
        parts = list(suffix_runs(self.buf, self.off, length))
        if not parts:
            return tuple(np.zeros(0, t) for t in (U64, U64, np.int64, np.int64, np.int64))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _write_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, n = TaskContext.get().partitionId(), 0
    release()
    for batch in batches:
        for rows, buf, off in chunks(batch):
            ids = rows.column(0).to_numpy()
            more = rows.select(range(2, rows.num_columns))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, more.schema) as out:
                out.write_batch(more)
            data = pa.compress(buf.tobytes(), codec="zstd", asbytes=True) if len(buf) else b""
            yield pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | n], pa.int64()), *(pa.array([x], pa.binary()) for x in (ids.tobytes(), np.diff(off).tobytes(), data, sink.getvalue().to_pybytes()))],
                names=["block", "ids", "sizes", "data", "more"],
            )
            n += 1


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}


def _split(by: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Places of each value, in order."""
    order = np.argsort(by, kind="stable")
    value = by[order]
    first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(by) else []
    for a, b in zip(first, np.append(first[1:], len(by)) if len(by) else [], strict=True):
        yield int(value[a]), order[a:b]


def _dealt(out: list[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Rows for ``TO_FAMILY`` in batches of about ``SMALL_BATCH`` bytes, one row at least; they leave ``out`` as they go."""
    while out:
        n = size = 0
        while n < len(out) and (not n or size + len(out[-1 - n][3]) <= SMALL_BATCH):
            size += len(out[-1 - n][3])
            n += 1
        cols = list(zip(*out[-n:], strict=True))
        del out[-n:]
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())],
            names=["family", "first", "block", "payload"],
        )


def _deal_runs(families: int, length: int):
    """Runs of every block, dealt to the families."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows_of(batches):
            release()
            block = Blocks(r["ids"], r["sizes"], r["data"])
            low, content, _, _, row = block.runs(length)
            out = []
            for family, at in _split((low % U64(families)).astype(np.int32)):
                docs, which = np.unique(row[at], return_inverse=True)
                out.append((family, int(block.ids[docs].min()), r["block"], pack((low[at] >> U64(32)).astype(np.uint32), content[at], which.astype(np.uint16), *narrow(block.ids[docs]))))
            yield from _dealt(out)

    return run


def _by_family(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, bytes]]]]:
    """(family, (block, payload) one after another) in the order of the sort; no payload is held here."""
    for family, rows in itertools.groupby(_rows_of(batches), key=lambda r: r["family"]):
        yield family, ((r["block"], r["payload"]) for r in rows)


def _answers(out: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) if out else [()] * 3
    return pa.RecordBatch.from_arrays(
        [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], names=["block", "family", "payload"]
    )


def _judge_runs(many_from: int):
    """For each block's runs: covered as a whole, or to be looked at suffix by suffix, and if so whether singly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for family, held in _by_family(batches):
            release()
            levels, lows, from_ = Family(), [], []
            for block, payload in held:
                low, content, which, base, above = unpack(payload, "u4", "u8", "u2", "i8", "u1")
                levels.add(content, widen(base, above, int(which.max()) + 1)[which])
                lows.append(low.copy())
                from_.append(block)
                del payload, low, content, which, base, above
            ask, many = ([np.zeros(len(x), bool) for x in lows] for _ in range(2))
            if levels.levels:
                start = np.cumsum([0] + [len(x) for x in lows])
                content, batch, at = levels.rest()
                at = at + start[batch]
                del batch
                low = np.concatenate(lows)[at]
                order = np.argsort(low, kind="stable")
                low, content, at = low[order], content[order], at[order]
                del order
                first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
                size = np.diff(np.append(first, len(low)))
                del low
                several = np.minimum.reduceat(content, first) != np.maximum.reduceat(content, first)
                del content
                for marks, which in ((ask, several), (many, several & (size >= many_from))):
                    flat = np.zeros(start[-1], bool)
                    flat[at[np.repeat(which, size)]] = True
                    marks[:] = [flat[a:b] for a, b in zip(start[:-1], start[1:], strict=True)]
            bits = zip(from_, levels.covered, ask, many, strict=True)
            answers = _answers([(block, family, pack(*map(np.packbits, marks))) for block, *marks in bits])
            yield answers.append_column("open", pa.array([int(x.sum()) for x in ask], pa.int64()))

    return run


def _suffixes(buf: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Suffixes cut at the length that matters. All have it, so dropped zero bytes at their ends don't confuse them."""
    return np.lib.stride_tricks.sliding_window_view(buf, length)[at].copy().view(f"S{length}").ravel()


def _hashes_at(buf: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the strings of ``length`` bytes that start at these places, a part of the buffer at a time."""
    out = np.zeros(len(at), U64)
    for k, own in _split(at // SEGMENT):
        start = at[own] - k * SEGMENT
        out[own] = span_hash(prefix_hash(buf[k * SEGMENT : (k + 1) * SEGMENT + length - 1]), start, start + length)
    return out


def _join_runs(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans, as few spans as possible (those that touch are joined)."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return start[new], np.append(end[:-1][new[1:]], end[-1])


def _send_contents(families: int, second: int, length: int):
    """What the first families decided, applied to each block: its covered spans, and the bytes of open runs, dealt to
    ``second`` families."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows_of(batches):
            release()
            block = Blocks(r["ids"], r["sizes"], r["data"])
            low, _, start, count, row = block.runs(length)
            covered, ask, many = (np.zeros(len(low), bool) for _ in range(3))
            answers = {a["family"]: a["payload"] for a in r["answers"] or ()}
            family = (low % U64(families)).astype(np.int32)
            for f, at in _split(family):
                for marks, bits in zip((covered, ask, many), unpack(answers[f], "u1", "u1", "u1"), strict=True):
                    marks[at] = np.unpackbits(bits, count=len(at)).view(bool)
            begin, end = start[covered], start[covered] + count[covered] + length - 1
            # single suffixes of hashes with many contents: the smallest document of the block speaks for all
            n = count[many]
            place = np.repeat(start[many] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            docs, dealt = np.repeat(block.ids[row[many]], n), np.zeros(0, np.int32)
            if len(place):
                keys = _suffixes(block.buf, place, length)
                order = np.argsort(docs, kind="stable")
                order = order[np.argsort(keys[order], kind="stable")]
                head = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
                least = np.repeat(docs[order][head], np.diff(np.append(head, len(order))))
                late = docs[order] > least
                begin, end = np.append(begin, place[order[late]]), np.append(end, place[order[late]] + length)
                place, docs = place[order[~late]], docs[order[~late]]
                dealt = (_hashes_at(block.buf, place, length) % U64(second)).astype(np.int32)
            # spans go the same way and are passed on, so the bytes of open runs are nowhere but in the shuffle
            out = [(-1 - int(r["block"] % second), LAST_ID, r["block"], pack(*_join_runs(begin, end)))]
            # runs, and single suffixes as runs of one
            at = np.flatnonzero(ask & ~many)
            start, count = np.append(start[at], place), np.append(count[at], np.ones(len(place), np.int64))
            docs = np.append(block.ids[row[at]], docs)
            for f, own in _split(np.append((low[at] % U64(second)).astype(np.int32), dealt)):
                size = count[own] + length - 1
                total = np.cumsum(size)
                where = np.repeat(start[own] - (total - size), size) + np.arange(int(total[-1]))
                out.append((f, int(docs[own].min()), r["block"], pack(block.buf[where], count[own].astype(np.uint8), *narrow(docs[own]), *narrow(start[own]))))
            yield from _dealt(out)

    return run


def _open_suffixes(held: Iterator[tuple[int, bytes]], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(keys, documents, places, blocks) of a family's open runs, several blocks at a time."""
    parts, n = [], 0

    def joined() -> tuple[np.ndarray, ...]:
        out = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        return out

    for block, payload in held:
        data, count, base, above, begin, beyond = unpack(payload, "u1", "u1", "i8", "u1", "i8", "u1")
        docs, start = widen(base, above, len(count)), widen(begin, beyond, len(count))
        count = count.astype(np.int64)
        size = count + length - 1
        nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        first = np.repeat(np.cumsum(size) - size, count) + nth
        # the suffix array's keys: all suffixes of the open runs, cut at the length that matters
        parts.append((_suffixes(data, first, length), np.repeat(docs, count), np.repeat(start, count) + nth, np.full(len(nth), block)))
        n += len(nth)
        del payload, data, count, docs, start, above, beyond, size, nth, first
        if n >= BATCH_SUFFIXES:
            n = 0
            yield joined()
    if parts:
        yield joined()


def _judge_suffixes(length: int):
    """Spans of single suffixes that an earlier document has; families below zero hold spans already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for family, held in _by_family(batches):
            if family < 0:
                yield from (_answers([(block, family, payload)]) for block, payload in held)
                continue
            release()
            levels, places = Family(), []
            for keys, docs, at, blocks in _open_suffixes(held, length):
                levels.add(keys, docs)
                places.append((at, blocks))
                del keys, docs
            levels.levels = []
            out = []
            for covered, (at, blocks) in zip(levels.covered, places, strict=True):
                at, blocks = at[covered], blocks[covered]
                # a block's suffixes stand together
                cuts = np.flatnonzero(np.diff(blocks)) + 1
                for own, block in zip(np.split(at, cuts), blocks[np.append(0, cuts)] if len(blocks) else [], strict=False):
                    out.append((int(block), family, pack(*_join_runs(own, own + length))))
            yield _answers(out)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for r in _rows_of(batches):
        block = Blocks(r["ids"], r["sizes"], r["data"])
        spans = [unpack(a["payload"], "i8", "i8") for a in r["answers"] or ()]
        start = np.concatenate([s[0] for s in spans]) if spans else np.zeros(0, np.int64)
        end = np.concatenate([s[1] for s in spans]) if spans else np.zeros(0, np.int64)
        # joined runs neither overlap nor touch, so at most one begins or ends at a byte
        start, end = _join_runs(start, end)
        step = np.zeros(len(block.buf) + 1, np.int8)
        step[start] = 1
        step[end] = -1
        gone = np.cumsum(step[:-1], dtype=np.int8).view(bool)
        digests, texts, removed, lists = [], [], [], []
        for a, b in zip(block.off[:-1].tolist(), block.off[1:].tolist(), strict=True):
            own = gone[a:b]
            kept = block.buf[a:b][~own].tobytes()
            edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
            digests.append(hashlib.sha256(kept).hexdigest())
            # a passage may begin or end within a character, of which no part is left then
            texts.append(kept.decode("utf-8", "ignore"))
            removed.append(int(own.sum()))
            lists.append(edge.tolist())
        more = pa.ipc.open_stream(r["more"]).read_all().combine_chunks()
        ids = pa.array(block.ids)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([None if i == LAST_ID else i for i in block.ids.tolist()], pa.int64()) if (block.ids == LAST_ID).any() else ids,
                pa.array(np.diff(block.off), pa.int64()), pa.array(removed, pa.int64()), pa.array([len(x) // 2 for x in lists], pa.int64()),
                pa.array(digests, pa.string()), pa.array(texts, pa.string()), pa.array(lists, pa.list_(pa.int64())),
                *(more.column(c).combine_chunks() if isinstance(more.column(c), pa.ChunkedArray) else more.column(c) for c in range(more.num_columns)),
            ],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans", *more.schema.names],
        )


def remove_repeats(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, spans)`` of every row.

    ``kept`` is the remaining text, ``spans`` the removed byte ranges as start, end, start, end, ... Columns named in
    ``carry`` come back as one struct ``carried``, whatever their names are.
    """
    if length < GRAM:
        raise ValueError(f"passages have {GRAM} bytes at least")
    more = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []
    rows = rows_with(docs, key, text, *more).withColumn("doc_id", known())

    def in_order(dealt: DataFrame) -> DataFrame:
        return dealt.repartition("family").sortWithinPartitions("family", "first", "block")

    def with_answers(blocks: DataFrame, answers: DataFrame) -> DataFrame:
        own = answers.groupBy("block").agg(F.collect_list(F.struct("family", "payload")).alias("answers"))
        return blocks.join(own, "block", "left")

    place = shared_dir(docs.sparkSession)
    with scratch(docs.sparkSession):  # the first copy of the blocks goes once there is one with answers
        blocks = settle(rows.mapInArrow(_write_blocks, BLOCKS))
        bound_batches(docs.sparkSession, SMALL_BATCH)  # blocks are as long as a batch of texts, but payloads travel a few at a time
        sizes = blocks.agg(F.sum(F.length("data")), F.count("*")).first()
        families = max(1, -(-3 * (sizes[0] or 0) // FAMILY_BYTES))  # texts are some three times their compressed size
        dealt = in_order(blocks.mapInArrow(_deal_runs(families, length), TO_FAMILY))
        judged = settle(dealt.mapInArrow(_judge_runs(MANY_CONTENTS), TO_BLOCK + ", open long"))
        # the second families are sized by the suffixes that are still open, not by text
        still = judged.agg(F.sum("open")).first()[0] or 0
        second = max(1, -(-still * (LONGEST_RUN + 1) // 2 // FAMILY_SUFFIXES))
        # written, so that the shuffle behind it is gone before the open runs are sent
        answered = settle(with_answers(blocks, judged), place)
    sent = in_order(answered.drop("more").mapInArrow(_send_contents(families, second, length), TO_FAMILY))
    spans = settle(sent.mapInArrow(_judge_suffixes(length), TO_BLOCK))
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string, spans array<long>"
    schema = StructType.fromDDL(out)
    if carry:
        schema = schema.add(rows.schema["carried"])
    return with_answers(answered.drop("answers"), spans).mapInArrow(_cut, schema)

"""Pack tokenised documents into sequences of fixed length.

Bounded-space online packing: every partition keeps a fixed number of open windows and places each document, or
what is left of it, into the fullest window that holds it. When none does, the fullest window is topped up with a
cut of the document and emitted. The windows still open at the end are merged over groups of partitions, level by
level, so the last task sees a bounded number of windows however many partitions there were.

Rows: a document with null or empty text has its end id only. Repeated ids are packed as separate documents. An
empty table gives no pieces. Extra columns are ignored. Texts of any length are cut where windows end.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.text import SMALL_BATCH, chunks, release, rows_with
from cohortflow.llm.tokens import shared_encoder, ship_spec
from cohortflow.session import settle

LENGTH = 4096
OPEN = 16
LEAST_CUT = 16
FAN_IN = 16
SMALL_CHUNK = 1 << 19  # bytes of text at once, as a worker holds the tokenizer as well
END_ID = 2

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
STATE = f"{PIECE}, part int, open boolean"
NAMES = [c.split()[0] for c in STATE.split(", ")]


class Windows:
    """Open windows of one partition. ``done`` and ``open`` hold (sequence, rows)."""

    def __init__(self, length: int, most: int, least_cut: int, base: int):
        self.length, self.most, self.least_cut, self.next = length, most, least_cut, base
        self.open: list[list] = []  # [used, sequence, rows]
        self.done: list[list] = []

    def _new(self) -> list:
        window = [0, self.next, []]
        self.next += 1
        return window

    def _put(self, window: list, row: tuple) -> None:
        window[2].append((*row, window[1], window[0]))
        window[0] += row[2]

    def add(self, doc, ids: bytes, doc_tokens: int) -> None:
        """Place a document, cutting it where a window ends."""
        at = 0

        def piece(n: int) -> tuple:
            return doc, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)]), doc_tokens

        while at < doc_tokens:
            left = doc_tokens - at
            if left >= self.length:
                window, n = self._new(), self.length
                self._put(window, piece(n))
                self.done.append(window)
            else:
                window = max((w for w in self.open if w[0] + left <= self.length), key=lambda w: w[0], default=None)
                n = left
                if window is None and len(self.open) < self.most:
                    self.open.append(window := self._new())
                if window is None:
                    window = max(self.open, key=lambda w: w[0])
                    n = self.length - window[0]
                    if n < self.least_cut:
                        n = 0
                    else:
                        self._put(window, piece(n))
                    self.open.remove(window)
                    self.done.append(window)
                else:
                    self._put(window, piece(n))
                    if window[0] == self.length:
                        self.open.remove(window)
                        self.done.append(window)
            at += n

    def drain(self, everything: bool = False) -> Iterator[tuple]:
        """Rows of finished windows; with ``everything`` those of the open ones too, marked."""
        for window in self.done:
            yield from ((*row, False) for row in window[2])
        self.done = []
        if everything:
            for window in self.open:
                yield from ((*row, True) for row in window[2])
            self.open = []


def _sequence_base(level: int, part: int) -> int:
    return level << 56 | part << 32


def _table(rows: list[tuple], part: int) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 8
    arrays = [pa.array(c, pa.int64()) for c in cols[:7]] + [pa.array([part] * len(rows), pa.int32()), pa.array(cols[7], pa.bool_())]
    return pa.RecordBatch.from_arrays(arrays, names=NAMES)


def _merger(level: int, length: int, most: int, final: bool):
    """For ``applyInPandas``: pack the pieces of a group's leftover windows anew, longest first, best fit."""

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        part = int(key[0])
        rows = rows.sort_values(["length", "doc_id", "start", "sequence_id", "offset"], ascending=[False, True, True, True, True])
        sequence, offset, room = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), []
        with_room: dict[int, list[int]] = {}
        rooms = 0  # bit r is set while a window with room r is there
        for k, n in enumerate(rows["length"].tolist()):
            fits = rooms >> n
            if fits:
                left = n + (fits & -fits).bit_length() - 1
                window = with_room[left].pop()
                if not with_room[left]:
                    rooms ^= 1 << left
            else:
                left, window = length, len(room)
                room.append(length)
            sequence[k], offset[k], room[window] = window, length - left, left - n
            with_room.setdefault(left - n, []).append(window)
            rooms |= 1 << (left - n)
        still = [] if final else sorted(range(len(room)), key=lambda w: -room[w])[:most]
        rows["open"] = np.isin(sequence, [w for w in still if room[w]])
        rows["sequence_id"], rows["offset"], rows["part"] = sequence + _sequence_base(level, part), offset, part
        return rows[NAMES]

    return merge


def pack(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", length: int = LENGTH,
    open_windows: int = OPEN, end_id: int | None = END_ID, least_cut: int = LEAST_CUT, fan_in: int = FAN_IN,
) -> DataFrame:
    """Pieces ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)`` of all documents.

    ``tokenizer`` is the path of a tokenizers file. Gaps of fewer than ``least_cut`` ids stay padding.
    Sequences of the partitions are settled, so the texts are tokenised once.
    """
    spec = ship_spec(docs.sparkSession, tokenizer)
    end = np.array([] if end_id is None else [end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = shared_encoder(spec.value), TaskContext.get().partitionId()
        windows = Windows(length, open_windows, least_cut, _sequence_base(0, part))
        release()
        for batch in batches:
            for rows, buf, off in chunks(batch, size=SMALL_CHUNK):
                ids, at = encoder.encode(buf, off)
                raw = ids.astype("<u4", copy=False).tobytes()
                for k, doc in enumerate(rows.column(0).to_pylist()):
                    own = raw[4 * at[k] : 4 * at[k + 1]] + end
                    windows.add(doc, own, len(own) >> 2)
                yield _table(list(windows.drain()), part)
        yield _table(list(windows.drain(everything=True)), part)

    state = settle(rows_with(docs, key, text, size=SMALL_BATCH).mapInArrow(run, STATE))
    done, level = [state.where(~F.col("open"))], 0
    left = state.where("open")
    parts = 1 + (left.agg(F.max("part")).first()[0] or 0)
    while True:
        level += 1
        groups = -(-parts // fan_in)
        merge = _merger(level, length, open_windows, final=groups == 1)
        merged = settle(left.groupBy(F.floor(F.col("part") / fan_in).cast("int").alias("group")).applyInPandas(merge, STATE))
        done.append(merged.where(~F.col("open")))
        if groups == 1:
            break
        left, parts = merged.where("open"), groups
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*NAMES[:7])

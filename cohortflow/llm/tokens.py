"""Token ids of whole texts, exactly as the tokenizers library gives them.

The tokenizer drops white space, never lets a piece span it, and cuts words where letters meet other signs, so the ids
of a text are those of its runs in order. The runs of a chunk are told apart by hash; each distinct one is encoded
once and kept in a bounded table that the tasks of a worker share. Words in which a cut could fall elsewhere (with
apostrophes, special tokens, or characters beyond the Latin letters) are encoded whole by the library itself.
"""

from __future__ import annotations

import sys
import types

import numpy as np
import pandas as pd
import regex
from pyspark.sql import SparkSession
from tokenizers import Tokenizer

from cohortflow.llm.text import BYTES, FOLDED, SPACE, U64, prefix_hash, span_hash, words

# How the tokenizer file cuts words, and the letters that stand for bytes in its pieces
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: chr(b) for b in PRINTABLE} | {
    b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in PRINTABLE)
}

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
CONTROL = np.zeros(256, bool)
CONTROL[[*range(32), 127]] = True
CONTROL &= ~SPACE

KEPT_RUNS = 1_500_000


def read_spec(path: str) -> str:
    """The tokenizer file, read once on the driver and sent with the task (some 2 MB)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def ship_spec(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(read_spec(path))


def shared_encoder(spec: str) -> WordEncoder:
    """One encoder for all tasks of a Python worker that use the same file."""
    place = sys.modules.setdefault("_cohortflow_worker", types.ModuleType("_cohortflow_worker"))
    kept = place.__dict__.get("encoder")
    if kept is None or kept[0] != hash(spec):
        place.__dict__["encoder"] = kept = (hash(spec), WordEncoder(spec))
    return kept[1]


def _unsure(buf: np.ndarray) -> np.ndarray:
    """Bytes whose word is encoded whole: apostrophes, control signs, the start of a special token, and whatever is
    no letter of the Latin blocks of two bytes (lead bytes C3 to C5, without the signs and the one letter whose lower
    case is two characters)."""
    after = np.append(buf[1:], np.uint8(0))
    odd = CONTROL[buf] | (buf == 0x27) | ((buf == 0x3C) & (after == 0x7C))
    high = np.flatnonzero(buf >= 0x80)
    if len(high):
        b, n = buf[high], after[high]
        before = np.where(high > 0, buf[high - 1], 0)
        lead = (b >= 0xC3) & (b <= 0xC5) & (n >= 0x80) & (n < 0xC0)
        lead &= ~((b == 0xC3) & ((n == 0x97) | (n == 0xB7))) & ~((b == 0xC4) & (n == 0xB0))
        odd[high] = ~lead & ~((b < 0xC0) & (before >= 0xC3) & (before <= 0xC5))
    return odd


class WordEncoder:
    """``encode(buf, off)``: ids of all rows in one array, and where each row's ids begin."""

    def __init__(self, spec: str, kept: int = KEPT_RUNS):
        self.tokenizer = Tokenizer.from_str(spec)
        self.model = self.tokenizer.model
        self.kept = kept
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.at, self.size = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def run(self, raw: bytes, whole: bool) -> list[int]:
        """Ids of one run: of letters, of other signs, or of a whole word."""
        if whole:
            return self.tokenizer.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids
        if raw.isalpha():
            return [t.id for t in self.model.tokenize(raw.lower().decode())]
        ids: list[int] = []
        for piece in SPLIT.findall(raw.decode("utf-8", "replace").lower()):
            ids += [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(BYTE_LETTERS))]
        return ids

    def _learn(self, hashes: np.ndarray, runs: list[tuple[bytes, bool]]) -> None:
        encoded = [self.run(*r) for r in runs]
        size = np.fromiter(map(len, encoded), np.int64, len(encoded))
        flat = np.fromiter((i for ids in encoded for i in ids), np.uint32, int(size.sum()))
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(self.used + len(flat), np.uint32)])
        self.pool[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(size) - size
        self.used += len(flat)
        order = np.argsort(hashes)
        place = np.searchsorted(self.hashes, hashes[order])
        self.hashes = np.insert(self.hashes, place, hashes[order])
        self.at = np.insert(self.at, place, at[order])
        self.size = np.insert(self.size, place, size[order])

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.searchsorted(self.hashes, hashes)
        have = place < len(self.hashes)
        have[have] = self.hashes[place[have]] == hashes[have]
        return place, have

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, end, begin = words(buf, off)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        odd = np.concatenate([[0], np.cumsum(_unsure(buf))])
        whole = odd[end] > odd[start]
        # cuts inside plain words, where letters and other signs meet
        letter = LETTER[buf]
        cut = np.flatnonzero((letter[1:] != letter[:-1]) & ~SPACE[buf[1:]] & ~SPACE[buf[:-1]]) + 1
        word = np.searchsorted(start, cut, "right") - 1
        cut = cut[(cut > start[word]) & ~whole[word]]
        run = np.concatenate([start, cut])
        order = np.argsort(run, kind="stable")
        run, whole = run[order], np.concatenate([whole, np.zeros(len(cut), bool)])[order]
        stop = np.append(run[1:], len(buf))
        last = np.append(order[1:] < len(start), True)  # the next run begins a word
        stop[last] = end
        begin = np.searchsorted(run, np.append(start, len(buf))[begin])

        h = span_hash(prefix_hash(buf, FOLDED), run, stop)
        if whole.any():
            h[whole] = span_hash(prefix_hash(buf, BYTES), run[whole], stop[whole]) + U64(1)
        codes, distinct = pd.factorize(h)
        place, have = self._find(distinct)
        if not have.all():
            first = np.full(len(distinct), -1)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            raw, new = buf.tobytes(), first[~have]
            runs = [(raw[a:b], w) for a, b, w in zip(run[new].tolist(), stop[new].tolist(), whole[new].tolist(), strict=True)]
            if len(self.hashes) + len(new) > self.kept:
                self._clear()
                runs = [(raw[a:b], w) for a, b, w in zip(run[first].tolist(), stop[first].tolist(), whole[first].tolist(), strict=True)]
                new = first
            self._learn(h[new], runs)
            place, _ = self._find(distinct)
        at, size = self.at[place], self.size[place]
        each = size[codes]
        total = np.concatenate([[0], np.cumsum(each)])
        ids = self.pool[np.repeat(at[codes] - total[:-1], each) + np.arange(total[-1])]
        return ids, total[begin]

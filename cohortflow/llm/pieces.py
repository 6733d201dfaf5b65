"""Sampled segmentations of whole texts into vocabulary pieces, without replacement, and back.

A text's segmentations are the paths of a lattice whose edges are pieces of a public SentencePiece vocabulary. A path's
probability is proportional to the product of its pieces' weights; weights follow Zipf's law in the vocabulary's merge
ranks, to the power ``ALPHA``. Adding independent Gumbel noise to all paths' log-probabilities and taking the largest
gives samples without replacement. The search never lists the paths: a node is a set of paths with a common beginning,
its best perturbed value is drawn from the set's exact mass, truncated by the value of the set it was split from, and
the node with the largest value is opened next. Opening a node draws its best path edge by edge and puts what is left of
the set at every edge back as a node. Values only fall, so paths come out in the order of their perturbed values.

Each sample has its log-probability, its perturbed value, and its inclusion score: the probability that its value
exceeds the next best value not sampled, which makes sums over samples, divided by it, unbiased. All noise derives from
the row's key, so a text with the same key gives the same samples anywhere.

Rows: null and empty texts have one empty segmentation. Texts with fewer segmentations than asked for give all of them,
each with inclusion 1. Repeated rows give the same samples again; a null key counts as 0. An empty table gives no rows.
Extra columns are ignored. Characters outside the vocabulary become bytes.
"""

from __future__ import annotations

import heapq
import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from cohortflow.llm.text import U64, chunks, mix, prefix_hash, rows_with, span_hash

SAMPLES = 4
ALPHA = 0.5
RANK_SHIFT = 10.0
TABLE_BITS = 20
NEAR = 64  # edges at a text's beginning, where most of what can still be opened lies
WINDOW = 384  # edges looked at first; more where a text needs them
MOST_NOISE = 40.0  # -log(-log(u)) of the largest u is below 37
PATHS_AT_ONCE = 64  # turned into ids and back
LARGE_CHUNK = 4 << 20  # the lattice of a word serves all its places in a chunk
MOST_LOG = 600.0  # products of weights are summed as they are where no logarithm is beyond that
SPACE_MARK = "▁"
PREFIXES = (3, 4, 5, 6, 7, 8, 10)  # lengths at which stretches that begin no longer piece are given up

# Bytes of a character by its first byte
CHARACTER_BYTES = np.array([1] * 192 + [2] * 32 + [3] * 16 + [4] * 16)
SAMPLE_ROWS = "doc_id long, sample int, n_pieces long, ids_crc32 long, log_prob double, perturbed double, inclusion double, decodes boolean"


def read_vocabulary(path: str) -> list[tuple[bytes, float, int]]:
    """``(bytes, merge rank, kind)`` of every piece, the mark of a space as a space; kind 0: piece, 1: byte, 2: control."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(model.get_piece_size()):
        text = model.id_to_piece(i)
        if model.is_byte(i):
            out.append((bytes([int(text[3:5], 16)]), 0.0, 1))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            out.append((b"", 0.0, 2))
        else:
            out.append((text.replace(SPACE_MARK, " ").encode(), -model.get_score(i), 0))
    return out


class Vocabulary:
    """Pieces by hash, with log-weights."""

    def __init__(self, pieces: list[tuple[bytes, float, int]], alpha: float = ALPHA):
        self.bytes = [p[0] for p in pieces]
        rank = np.minimum([p[1] for p in pieces], len(pieces))
        self.weight = -alpha * np.log(rank + RANK_SHIFT)
        self.byte_weight = -alpha * np.log(len(pieces) + RANK_SHIFT)
        self.byte_ids = np.zeros(256, np.int64)
        for i, (raw, _, kind) in enumerate(pieces):
            if kind == 1:
                self.byte_ids[raw[0]] = i
        use = [i for i, p in enumerate(pieces) if p[2] == 0 and p[0]]
        joined = np.frombuffer(b"".join(self.bytes[i] for i in use), np.uint8)
        size = np.array([len(self.bytes[i]) for i in use], np.int64)
        end = np.cumsum(size)
        h = span_hash(prefix_hash(joined), end - size, end)
        self.lengths = np.unique(size)
        # two tables with different bits of the hash; what collides in the first is in the second
        self.hashes, self.ids, self.tables = np.append(h, U64(0)), np.append(np.array(use), -1), []
        left = np.arange(len(use))
        for shift in (64 - TABLE_BITS, 24, 4):
            table = np.full(1 << TABLE_BITS, len(use), np.int32)
            slot = ((h[left] >> U64(shift)) & U64((1 << TABLE_BITS) - 1)).astype(np.int64)
            table[slot] = left
            left = left[table[slot] != left]
            self.tables.append((shift, table))
        if len(left):
            raise ValueError("pieces cannot be told apart")
        self.goes_on = {}
        for n in PREFIXES:
            longer = size > n
            table = np.zeros(1 << TABLE_BITS, bool)
            begin = (end - size)[longer]
            table[(span_hash(prefix_hash(joined), begin, begin + n) >> U64(64 - TABLE_BITS)).astype(np.int64)] = True
            self.goes_on[n] = table
        # pieces of one and two bytes by their bytes, and whether longer ones begin like that
        self.short = {n: np.full(1 << 8 * n, -1, np.int32) for n in (1, 2)}
        self.short_goes_on = {n: np.zeros(1 << 8 * n, bool) for n in (1, 2)}
        for i in use:
            raw = self.bytes[i]
            if len(raw) < 3:
                self.short[len(raw)][int.from_bytes(raw)] = i
            for n in (1, 2):
                if len(raw) > n:
                    self.short_goes_on[n][int.from_bytes(raw[:n])] = True
        self.decode_size = np.array([len(p) for p in self.bytes], np.int64)
        self.decode_at = np.cumsum(self.decode_size) - self.decode_size
        self.decode_pool = np.frombuffer(b"".join(self.bytes), np.uint8)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids of pieces by hash, -1 where there is none."""
        out = np.full(len(h), -1)
        left = np.arange(len(h))
        for k, (shift, table) in enumerate(self.tables):
            at = table[((h[left] >> U64(shift)) & U64((1 << TABLE_BITS) - 1)).astype(np.int64)]
            if not k:  # a piece that lost its place there has another one in it: where there is none, no piece is
                left, at = left[there := at < len(self.ids) - 1], at[there]
            hit = self.hashes[at] == h[left]
            out[left[hit]] = self.ids[at[hit]]
            left = left[~hit]
        return out

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the pieces of texts that end at ``ends``, and where theirs end; every text has a space in front."""
        size = self.decode_size[ids]
        total = np.cumsum(size)
        place = np.repeat(self.decode_at[ids] - (total - size), size) + np.arange(int(total[-1]) if len(ids) else 0)
        return self.decode_pool[place], np.append(0, total)[ends]


@dataclass
class Lattice:
    """All edges of some units (distinct stretches of text that no piece crosses), by the state they leave.

    A state is a position in a unit; its edges are ``first[s]`` to ``first[s + 1]``. ``chance`` is an edge's probability
    among the completions from its state.
    """

    first: np.ndarray
    target: np.ndarray
    piece: np.ndarray  # -1: the character's bytes
    chance: np.ndarray
    upto: np.ndarray  # summed chances of a state's edges as far as this one; above 1 at the last
    start: np.ndarray  # state of each unit's begin
    final: np.ndarray  # whether a state is a unit's end
    source: np.ndarray  # byte position of a state


def build_lattice(v: Vocabulary, buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Lattice:
    """Lattice of the units ``buf[begin:end]``. States are counted by bytes; only those between characters have edges."""
    size = end - begin + 1
    start = np.cumsum(size) - size
    unit = np.repeat(np.arange(len(size)), size)
    source = begin[unit] + np.arange(len(unit)) - start[unit]
    left = end[unit] - source  # bytes to the end of the unit
    lead = np.zeros(len(unit), bool)
    inside = left > 0
    lead[inside] = (buf[source[inside]] & 0xC0) != 0x80
    prefix = prefix_hash(buf)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    own_length = np.zeros(len(unit), np.int64)  # of the character
    own_length[lead] = CHARACTER_BYTES[buf[source[lead]]]
    own_length = np.minimum(own_length, left)
    lone = lead.copy()  # characters that are no pieces
    at = np.flatnonzero(lead).astype(np.int32)  # a state's number: texts have fewer bytes
    for n in v.lengths.tolist():
        at = at[left[at] >= n]
        if not len(at):
            break
        if n in v.short:
            begins = buf[source[at]].astype(np.int64)
            if n == 2:
                begins = (begins << 8) + buf[source[at] + 1]
            piece = v.short[n][begins]
        else:
            h = span_hash(prefix, source[at], source[at] + n)
            piece = v.find(h)
        hit = piece >= 0
        own = at[hit]
        found.append((own, own + np.int32(n), piece[hit].astype(np.int32)))
        lone[own[own_length[own] == n]] = False
        if n in v.short:
            at = at[v.short_goes_on[n][begins]]
        elif n in v.goes_on:
            at = at[v.goes_on[n][(h >> U64(64 - TABLE_BITS)).astype(np.int64)]]
    at = np.flatnonzero(lone)
    # longer pieces first: they are the likelier ones
    found = [(at.astype(np.int32), (at + own_length[at]).astype(np.int32), np.full(len(at), -1, np.int32)), *found][::-1]
    froms, tos, ids = (np.concatenate(x) for x in zip(*found, strict=True))
    del found, prefix
    order = np.argsort(froms, kind="stable")
    froms, tos, ids = froms[order], tos[order], ids[order]
    weight = np.where(ids >= 0, v.weight[ids], v.byte_weight * own_length[froms])

    # edges by the bytes left to their units' ends, so that summed weights of all completions go backwards
    far = left[froms]
    order = np.argsort(far.astype(np.uint16) if len(far) and far.max() < 1 << 16 else far, kind="stable")
    far, src, to, edge_weight = far[order], froms[order], tos[order], weight[order]
    steps = np.flatnonzero(np.concatenate([[True], far[1:] != far[:-1]])) if len(far) else np.zeros(0, np.int64)
    heads = np.concatenate([[True], (src[1:] != src[:-1]) | (far[1:] != far[:-1])]) if len(far) else np.zeros(0, bool)
    plain = int(left.max(initial=0)) * max(-float(weight.min(initial=0)), -v.byte_weight) < MOST_LOG
    rest = np.zeros(len(unit)) if plain else np.full(len(unit), -np.inf)
    rest[~inside] = 1.0 if plain else 0.0
    del weight
    if plain:
        edge_weight = np.exp(edge_weight)
    for a, b in zip(steps.tolist(), np.append(steps[1:], len(far)).tolist(), strict=True) if len(far) else ():
        head = np.flatnonzero(heads[a:b])
        if plain:
            rest[src[a:b][head]] = np.add.reduceat(edge_weight[a:b] * rest[to[a:b]], head)
            continue
        value = edge_weight[a:b] + rest[to[a:b]]
        top = np.maximum.reduceat(value, head)
        safe = np.where(np.isfinite(top), top, 0.0)
        sums = np.add.reduceat(np.exp(value - np.repeat(safe, np.diff(np.append(head, b - a)))), head)
        with np.errstate(divide="ignore"):
            rest[src[a:b][head]] = safe + np.log(sums)
    after, here = rest[to], rest[src]
    del heads, src, to
    reach = (after > 0) & (here > 0) if plain else np.isfinite(after) & np.isfinite(here)
    chance = np.zeros(len(far))
    chance[order] = edge_weight * after / np.where(reach, here, 1.0) if plain else np.exp(edge_weight + after - np.where(reach, here, 0.0))
    if not reach.all():
        keep = np.zeros(len(far), bool)
        keep[order] = reach
        froms, tos, ids, chance = froms[keep], tos[keep], ids[keep], chance[keep]
    first = np.concatenate([[0], np.cumsum(np.bincount(froms, minlength=len(unit)))])
    # a state has few edges: add up those of one place at a time
    del after, here, edge_weight, order, reach, rest
    upto, nth = chance.copy(), (np.arange(len(froms)) - first[froms]).astype(np.int32)
    later, n = np.flatnonzero(nth == 1), 1
    while len(later):
        upto[later] += upto[later - 1]
        later, n = later[later < len(nth) - 1] + 1, n + 1
        later = later[nth[later] == n]
    upto[first[1:][np.diff(first) > 0] - 1] = 2.0
    return Lattice(first, tos.astype(np.int32), ids.astype(np.int32), chance, upto, start, ~inside, source)


SALTS = mix(np.arange(1, 4097, dtype=U64))


def _uniform(key: np.ndarray) -> np.ndarray:
    """Numbers strictly between 0 and 1."""
    return ((mix(key) >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def walk(lat: Lattice, state: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Random paths from states to their units' ends: all edges, walk by walk, and where each walk begins."""
    taken = []
    who = np.flatnonzero(~lat.final[state])
    now, own, step = state[who], key[who], 0
    count = np.zeros(len(state), np.int64)
    while len(who):
        pick = lat.first[now]
        u = _uniform(own + SALTS[step % len(SALTS)] + U64(step // len(SALTS)))
        over = np.flatnonzero(u >= lat.upto[pick])
        while len(over):  # pass over edges whose chances together do not reach the number
            pick[over] += 1
            over = over[u[over] >= lat.upto[pick[over]]]
        taken.append((who, pick))
        count[who] += 1
        now = lat.target[pick]
        on = np.flatnonzero(~lat.final[now])
        who, now, own, step = who[on], now[on], own[on], step + 1
    begin = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(int(begin[-1]), np.int64)
    for step, (who, pick) in enumerate(taken):
        out[begin[who] + step] = pick
    return out, begin


@dataclass
class Node:
    """Paths that begin like ``path[:at]`` and then take another edge than the ``taken`` ones."""

    path: np.ndarray  # edges
    units: np.ndarray  # unit number in the text of each edge
    at: int
    taken: list[int]


class Sampler:
    """Samples of the texts of one chunk."""

    def __init__(self, v: Vocabulary, buf: np.ndarray, off: np.ndarray, keys: np.ndarray):
        # every text gets a space in front; a unit begins at a space that follows none
        self.v, n = v, len(off) - 1
        full = np.flatnonzero(np.diff(off) > 0)
        self.buf = np.insert(buf, off[full], np.uint8(32))
        shift = np.zeros(n + 1, np.int64)
        shift[1:] = np.cumsum(np.diff(off) > 0)
        self.off = off + shift
        space = self.buf == 32
        begin = space.copy()
        begin[1:] &= ~space[:-1]
        begin[self.off[:-1][full]] = True
        self.begin = np.flatnonzero(begin)
        self.end = np.append(self.begin[1:], len(self.buf))
        self.unit_of = np.searchsorted(self.begin, self.off)
        h = span_hash(prefix_hash(self.buf), self.begin, self.end) if len(self.begin) else np.zeros(0, U64)
        codes, distinct = pd.factorize(h)
        first = np.full(len(distinct), -1)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        self.lat = build_lattice(v, self.buf, self.begin[first], self.end[first])
        self.start = self.lat.start[codes]
        self.keys = mix(keys.astype(U64) + U64(0xA5A5))
        with np.errstate(divide="ignore"):
            self.log_chance = np.log(self.lat.chance)
            self.log_other = np.log1p(-np.minimum(self.lat.chance, 1.0))

    def _paths(self, rows: list[int], heads: list[np.ndarray], head_units: list[np.ndarray], states: list[int], unit: list[int], turn: int):
        """Complete beginnings of paths: the state in a unit is walked to its end, and all later units from their begin.

        All edges with their units, path by path, and where each path begins.
        """
        r, first = np.array(rows), np.array(unit)
        size = self.unit_of[r + 1] - self.unit_of[r] - first
        total = np.cumsum(size)
        walked = np.repeat(first - (total - size), size) + np.arange(int(total[-1]))
        starts = self.start[np.repeat(self.unit_of[r], size) + walked]
        starts[total - size] = states
        edges, begin = walk(self.lat, starts, mix(np.repeat(self.keys[r] + SALTS[turn], size) + walked.astype(U64)))
        own = begin[total] - begin[total - size]
        ahead = np.array([len(h) for h in heads])
        end = np.cumsum(own + ahead)
        out, units = np.empty(int(end[-1]), np.int64), np.empty(int(end[-1]), np.int32)
        tail = np.repeat(np.cumsum(ahead), own) + np.arange(len(edges))
        out[tail], units[tail] = edges, np.repeat(walked, np.diff(begin))
        if ahead.any():
            front = np.repeat(np.cumsum(own) - own, ahead) + np.arange(int(ahead.sum()))
            out[front], units[front] = np.concatenate(heads), np.concatenate(head_units)
        return out, units, end - own - ahead, own + ahead

    def run(self, samples: int) -> Iterator[tuple[int, int, np.ndarray, float, float, float]]:
        """``(row, sample, edges, log probability, perturbed value, inclusion)``."""
        n = len(self.off) - 1
        rows = [r for r in range(n) if self.unit_of[r + 1] > self.unit_of[r]]
        for r in range(n):
            if self.unit_of[r + 1] == self.unit_of[r]:
                yield r, 0, np.zeros(0, np.int64), 0.0, float(-np.log(-np.log(_uniform(self.keys[r : r + 1])[0]))), 1.0
        if not rows:
            return
        heaps: dict[int, list[tuple[float, int, Node]]] = {r: [] for r in rows}
        found: dict[int, list[tuple[np.ndarray, float, float]]] = {r: [] for r in rows}
        empty = np.zeros(0, np.int64)
        value = {r: float(g) for r, g in zip(rows, -np.log(-np.log(_uniform(self.keys[rows]))), strict=True)}
        opened: dict[int, Node | None] = {r: None for r in rows}
        heads, head_units = [empty] * len(rows), [empty] * len(rows)
        states, unit = [int(self.start[self.unit_of[r]]) for r in rows], [0] * len(rows)
        for turn in range(samples):
            edges, units, begin, size = self._paths(rows, heads, head_units, states, unit, turn)
            top = np.array([value[r] for r in rows])
            noises = mix(self.keys[rows] + SALTS[turn + 1001])

            few = samples - turn
            # edges before the split are part of other nodes
            since = np.array([0 if (node := opened[r]) is None else node.at for r in rows])
            near = np.minimum(size, since + WINDOW)
            while True:
                text, place, first, mass, end = self._masses(rows, opened, edges, begin, near)

                def splits(at: np.ndarray, text=text, place=place, mass=mass) -> np.ndarray:
                    own, held = text[at], mass[at]
                    noise = _uniform(noises[own] + place[at].astype(U64))
                    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                        out = held - np.log(np.exp(held - top[own]) - np.log(noise))
                    out[~np.isfinite(held)] = -np.inf
                    return out

                # only the best few can still be opened: those not below the last of the best few where it may first part
                head = (first + since)[:, None] + np.arange(NEAR)
                there = np.arange(NEAR) < (near - since)[:, None]
                early = np.full(head.shape, -np.inf)
                early[there] = splits(head[there])
                bar = np.partition(early, NEAR - few, axis=1)[:, NEAR - few]
                # noise lifts no set by more than MOST_NOISE, and masses behind the window are below its last: the others need none
                more = (near < size) & (end >= bar - MOST_NOISE)
                if not more.any():
                    break
                near = np.where(more, np.minimum(size, 2 * near), near)
            able = np.flatnonzero((mass >= (bar - MOST_NOISE)[text]) & np.isfinite(mass))
            split = splits(able)
            real = (split >= bar[text[able]]) & np.isfinite(split)
            able, split = able[real], split[real]
            ranked = np.lexsort((able, -split, text[able]))
            order, split = able[ranked], split[ranked]
            owner = text[order]
            rank = np.arange(len(order)) - np.searchsorted(owner, owner)
            best = rank < few
            for at, g in zip(order[best].tolist(), split[best].tolist(), strict=True):
                k, nth = int(text[at]), int(place[at])
                node = opened[rows[k]]
                upto = slice(int(begin[k]), int(begin[k]) + nth + 1)  # all that is needed of the path
                taken = [int(edges[upto.stop - 1])] + (node.taken if node is not None and nth == node.at else [])
                heapq.heappush(heaps[rows[k]], (-g, turn * (1 << 40) + nth, Node(edges[upto].copy(), units[upto].copy(), nth, taken)))
            total = np.add.reduceat(self.log_chance[edges], begin)
            for k, r in enumerate(rows):
                found[r].append((edges[begin[k] : begin[k] + size[k]], float(total[k]), value[r]))
            if turn + 1 == samples:
                break
            rows = [r for r in rows if heaps[r]]
            if not rows:
                break
            heads, head_units, states, unit = [], [], [], []
            draws = _uniform(mix(self.keys[rows] + SALTS[turn + 2001])).tolist()
            for r, draw in zip(rows, draws, strict=True):
                g, _, node = heapq.heappop(heaps[r])
                value[r], opened[r] = -g, node
                edge = self._another(node, draw)
                heads.append(np.append(node.path[: node.at], edge))
                head_units.append(node.units[: node.at + 1])
                states.append(int(self.lat.target[edge]))
                unit.append(int(node.units[node.at]))
        for r, own in found.items():
            limit = -heaps[r][0][0] if heaps[r] else -np.inf
            for s, (edges, log_p, g) in enumerate(own):
                yield r, s, edges, log_p, g, float(-np.expm1(-np.exp(min(log_p - limit, 50.0)))) if np.isfinite(limit) else 1.0

    def _masses(self, rows: list[int], opened: dict[int, Node | None], edges: np.ndarray, begin: np.ndarray, near: np.ndarray):
        """Of the first ``near`` edges of every path: path, place in it, where each path begins among them, and the log of the
        chance of what leaves the path at each edge; then the log of the chance of all that follows the last of them."""
        total = np.cumsum(near)
        first = total - near
        text = np.repeat(np.arange(len(near)), near)
        place = np.arange(len(text)) - first[text]
        own = edges[begin[text] + place]
        log_p = self.log_chance[own]
        upto = np.cumsum(log_p)
        base = np.concatenate([[0.0], upto])[first]
        before = upto - log_p
        before -= base[text]
        mass = before + self.log_other[own]
        for k, r in enumerate(rows):  # the edge at the split has siblings gone
            node = opened[r]
            if node is not None:
                at = first[k] + node.at
                mass[first[k] : at] = -np.inf
                gone = sum(self.lat.chance[e] for e in (*node.taken, own[at]))
                mass[at] = before[at] + self._others(own[at], (*node.taken, int(own[at])), gone)
        return text, place, first, mass, upto[total - 1] - base

    def _siblings(self, edge: int) -> np.ndarray:
        state = int(np.searchsorted(self.lat.first, edge, "right")) - 1
        return np.arange(self.lat.first[state], self.lat.first[state + 1])

    def _others(self, edge: int, taken: tuple[int, ...], gone: float) -> float:
        """Log of the chance of an edge's siblings that are not taken."""
        rest = [e for e in self._siblings(edge).tolist() if e not in taken]
        return float(np.log(sum(self.lat.chance[e] for e in rest))) if rest and gone < 1 else -np.inf

    def _another(self, node: Node, draw: float) -> int:
        edges = [e for e in self._siblings(int(node.path[node.at])).tolist() if e not in node.taken]
        total = np.cumsum(self.lat.chance[edges])
        return edges[min(int(np.searchsorted(total, draw * total[-1], "right")), len(edges) - 1)]

    def ids(self, edges: np.ndarray) -> np.ndarray:
        """Piece ids of a path; characters outside the vocabulary as bytes."""
        return self.all_ids(edges, np.array([len(edges)]))[0]

    def all_ids(self, edges: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of paths that end at ``ends``, and where theirs end."""
        piece = self.lat.piece[edges]
        lone = np.flatnonzero(piece < 0)
        if not len(lone):
            return piece, ends
        state = np.searchsorted(self.lat.first, edges[lone], "right") - 1
        size = self.lat.target[edges[lone]] - state
        each = np.ones(len(piece), np.int64)
        each[lone] = size
        out = np.repeat(piece, each)
        at = self.lat.source[state]
        out[out < 0] = self.v.byte_ids[self.buf[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]]
        return out, ends + np.append(0, np.cumsum(size - 1))[np.searchsorted(lone, ends)]


def sample(docs: DataFrame, model: str, samples: int = SAMPLES, alpha: float = ALPHA, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """``samples`` distinct segmentations of every text, by falling perturbed value.

    ``model`` is the path of a SentencePiece file. With ``with_ids`` the ids themselves are returned as ``ids``.
    """
    if samples > NEAR:
        raise ValueError(f"{NEAR} samples at most")
    shipped = docs.sparkSession.sparkContext.broadcast(read_vocabulary(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(shipped.value, alpha)
        for batch in batches:
            for rows, buf, off in chunks(batch, size=LARGE_CHUNK):
                ids_ = rows.column(0)
                sampler = Sampler(v, buf, off, ids_.fill_null(0).to_numpy())
                out = []
                for some in itertools.batched(sampler.run(samples), PATHS_AT_ONCE):
                    ids, ends = sampler.all_ids(np.concatenate([x[2] for x in some]), np.cumsum([len(x[2]) for x in some]))
                    ids = ids.astype("<u4")
                    texts, text_ends = v.decode(ids, ends)
                    a = c = 0
                    for (r, s, _, *values), b, d in zip(some, ends.tolist(), text_ends.tolist(), strict=True):
                        own, whole = ids[a:b], texts[c + 1 : d].tobytes() == buf[off[r] : off[r + 1]].tobytes()
                        out.append((r, s, b - a, zlib.crc32(own), *values, whole, own.astype(np.int32) if with_ids else None))
                        a, c = b, d
                out.sort(key=lambda x: x[:2])
                cols = list(zip(*out, strict=True)) if out else [()] * 9
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]
                arrays = [ids_.take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cols[1:8], kinds, strict=True))]
                names = [c.split()[0] for c in SAMPLE_ROWS.split(", ")]
                if with_ids:
                    arrays.append(pa.array([x.tolist() for x in cols[8]], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows_with(docs, key, text).mapInArrow(run, SAMPLE_ROWS + (", ids array<int>" if with_ids else ""))

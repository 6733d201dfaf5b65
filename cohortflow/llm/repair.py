"""Repair of conversation structure by the cheapest edits, found in one pass over each conversation.

A repaired conversation is empty, or an optional system turn and then turns of user and assistant in pairs. Rows are kept,
given another role, or deleted, and empty turns can be put in; blank rows and rows seen before have to go. Four states
tell what came last; per state the cheapest way so far survives, of equally cheap ones that whose edits read least.

Survivors are leaves of a tree of back pointers. Each entry counts the entries and survivors that point to it and goes
when none does; a survivor goes when another one can do whatever it could at less cost. As soon as all survivors descend
from one entry, the edits up to it are final and leave the tree. So memory follows the undecided stretch, not the
conversation: a conversation of any length is a stream through one task. Where two ways cost the same, their whole
undecided edits are compared.

Spark sorts the rows of a conversation by turn and finds the repeated ones; only the search itself is Python.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What separates words, and the signs that end a complete turn
BLANK = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")

START, SYSTEM, USER, ASSISTANT = range(4)
# what a kept row of this initial, a user turn, or an assistant turn leads to
BY_INITIAL = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NEXT = ((USER, "user"), (USER, "user"), (ASSISTANT, "assistant"), (USER, "user"))
FINAL = (START, ASSISTANT)
LEGAL = {"su", "ua", "au"}

EDITS = pa.schema([
    ("conv_id", pa.int64()), ("step", pa.int64()), ("edit", pa.string()), ("cost", pa.int64()), ("turn", pa.int64()),
    ("old_role", pa.string()), ("fault", pa.string()), ("role", pa.string()), ("text", pa.string()),
])
EDITS_SQL = "conv_id long, step long, edit string, cost long, turn long, old_role string, fault string, role string, text string"
DIGESTS = pa.schema([
    ("conv_id", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
    ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string()),
])
DIGESTS_SQL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
OUT_ROWS, OUT_CHARS = 2000, 1 << 20


@dataclass(frozen=True)
class Costs:
    """What an edit costs; ``truncated`` is added for every truncated row that stays. Inserts must cost something."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5

    def __post_init__(self):
        if min(self.rerole, self.delete, self.truncated) < 0 or self.insert <= 0:
            raise ValueError("costs must not be negative, and inserts must cost something")

    def ahead(self) -> list[list[float]]:
        """``ahead()[p][q]``: at most so much more than from q does it cost to finish from p, whatever follows.

        From p one may insert turns up to q. After an assistant turn one can go on as after the system turn, and as from
        the start if a system turn that would stay is deleted.
        """
        far = [[0.0 if p == q else float("inf") for q in range(4)] for p in range(4)]
        for p, (q, _) in enumerate(NEXT):
            far[p][q] = self.insert
        far[ASSISTANT][SYSTEM] = 0
        far[ASSISTANT][START] = self.delete
        for k in range(4):
            for p in range(4):
                for q in range(4):
                    far[p][q] = min(far[p][q], far[p][k] + far[k][q])
        return far


class Entry:
    """One edit, and the edit before it."""

    __slots__ = ("before", "letter", "cost", "row", "role", "length", "users")

    def __init__(self, before, letter, cost, row, role):
        self.before, self.letter, self.cost, self.row, self.role = before, letter, cost, row, role
        self.length = 0 if before is None else before.length + 1
        self.users = 0
        if before is not None:
            before.users += 1


def _release(entry: Entry | None) -> None:
    while entry is not None and entry.users == 0:
        before, entry.before = entry.before, None
        if before is not None:
            before.users -= 1
        entry = before


def reads_less(a: Entry, b: Entry) -> bool:
    """Whether the edits up to ``a`` come before those up to ``b``, compared back to where they part."""
    left, right = [], []
    while a is not b:
        if a.length >= b.length:
            left.append(a.letter)
            a = a.before
        else:
            right.append(b.letter)
            b = b.before
    return left[::-1] < right[::-1]


class Search:
    """The edits of one conversation: ``add`` rows in order, take final edits from ``settled``, end with ``finish``.

    A row is a tuple that begins with role, text and fault; edits come as ``(letter, cost, row, new role)``, with no row
    for an insert.
    """

    def __init__(self, costs: Costs):
        self.costs, self.far = costs, costs.ahead()
        self.root = Entry(None, "", 0, None, None)
        self.alive: dict[int, tuple[int, Entry]] = {START: (0, self.root)}
        self.root.users += 1
        self._insert()

    def _better(self, found: dict, state: int, cost: int, entry: Entry) -> bool:
        if state not in found or cost < found[state][0]:
            return True
        return cost == found[state][0] and reads_less(entry, found[state][1])

    def _put(self, found: dict, state: int, cost: int, entry: Entry) -> bool:
        """Hold an entry for a state unless a better one is held."""
        if not self._better(found, state, cost, entry):
            _release(entry)
            return False
        entry.users += 1
        if state in found:
            old = found[state][1]
            old.users -= 1
            found[state] = (cost, entry)
            _release(old)
        else:
            found[state] = (cost, entry)
        return True

    def _insert(self) -> None:
        """Turns put in behind what there is, as long as that makes a state cheaper."""
        changed = list(self.alive)
        while changed:
            again = []
            for state in changed:
                cost, entry = self.alive[state]
                to, role = NEXT[state]
                if to in self.alive and self.alive[to][0] < cost + self.costs.insert:
                    continue
                if self._put(self.alive, to, cost + self.costs.insert, Entry(entry, "I", self.costs.insert, None, role)):
                    again.append(to)
            changed = again

    def add(self, row: tuple) -> None:
        role, _, fault = row[:3]
        costs, found = self.costs, {}
        more = costs.truncated if fault == "truncated" else 0
        stays = fault not in ("blank", "duplicate")
        initial = BY_INITIAL.get(role[:1], {})
        for state, (cost, entry) in self.alive.items():
            self._put(found, state, cost + costs.delete, Entry(entry, "D", costs.delete, row, None))
            if stays:
                if state in initial:
                    self._put(found, initial[state], cost + more, Entry(entry, "K", more, row, role))
                to, name = NEXT[state]
                self._put(found, to, cost + costs.rerole + more, Entry(entry, "R", costs.rerole + more, row, name))
        self._drop(self.alive)
        self.alive = found
        self._insert()
        hopeless = {
            q: self.alive[q] for q in self.alive
            if any(self.alive[p][0] + self.far[p][q] < self.alive[q][0] for p in self.alive)
        }
        for q in hopeless:
            del self.alive[q]
        self._drop(hopeless)

    @staticmethod
    def _drop(gone: dict) -> None:
        for _, entry in gone.values():
            entry.users -= 1
            _release(entry)

    def settled(self) -> list[tuple]:
        """Edits that all survivors share and that were not given out before."""
        if self.root.users != 1:
            return []
        path, entry = [], next(iter(self.alive.values()))[1]
        while entry is not self.root:
            path.append(entry)
            entry = entry.before
        out = []
        while path and self.root.users == 1:
            new = path.pop()
            out.append((new.letter, new.cost, new.row, new.role))
            self.root, new.before = new, None
        return out

    def finish(self) -> list[tuple]:
        """The rest of the edits."""
        best = None
        for state in FINAL:
            if state in self.alive:
                cost, entry = self.alive[state]
                if best is None or cost < best[0] or (cost == best[0] and reads_less(entry, best[1])):
                    best = (cost, entry)
        out, entry = [], best[1]
        while entry is not self.root:
            out.append((entry.letter, entry.cost, entry.row, entry.role))
            entry = entry.before
        return out[::-1]


def _fault(text: str, again: bool) -> str:
    bare = text.rstrip(BLANK)
    return "blank" if not bare else "duplicate" if again else "" if bare.endswith(ENDS) else "truncated"


def _edits(batches: Iterator[pa.RecordBatch], costs: Costs, every: int = 32) -> Iterator[tuple]:
    """Edits as tuples in the order of ``EDITS``. A conversation of no rows gives one without an edit."""
    now, search, step, last, any_row = object(), None, 0, None, False

    def told(found: list[tuple]) -> Iterator[tuple]:
        nonlocal step
        for letter, cost, row, role in found:
            old, text, fault, turn = row if row is not None else (None, "", "", None)
            yield now, step, letter, cost, turn, old, fault, role, None if role is None else text
            step += 1

    def ended() -> Iterator[tuple]:
        if search is not None:
            if any_row:
                yield from told(search.finish())
            else:
                yield now, 0, None, 0, None, None, None, None, None

    seen = 0
    for batch in batches:
        for conv, turn, role, text, there, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if search is None or conv != now:
                yield from ended()
                now, search, step, last, any_row = conv, Search(costs), 0, None, False
            if not there:
                continue
            # rows that are equal stand side by side unless their turns differ, which ``again`` tells
            same = (turn, role, text) == last
            last, any_row = (turn, role, text), True
            search.add((role, text, _fault(text, again or same), turn))
            seen += 1
            if seen % every == 0:
                yield from told(search.settled())
    yield from ended()


def _edit_batches(batches: Iterator[pa.RecordBatch], costs: Costs) -> Iterator[pa.RecordBatch]:
    rows, chars = [], 0
    for row in _edits(batches, costs):
        rows.append(row)
        chars += len(row[-1] or "")
        if len(rows) >= OUT_ROWS or chars >= OUT_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), EDITS.types, strict=True)], schema=EDITS)
            rows, chars = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), EDITS.types, strict=True)], schema=EDITS)


class Digest:
    """Counts, audit and hash of one conversation, taken up edit by edit."""

    def __init__(self, conv):
        self.conv, self.count, self.cost, self.illegal = conv, {"blank": 0, "duplicate": 0, "truncated": 0}, 0, 0
        self.low = self.high = self.turn = self.before = None
        self.distinct, self.letters, self.hash, self.lines = 0, [], hashlib.sha256(), 0

    def take(self, letter, cost, turn, old, fault, role, text) -> None:
        self.letters.append(letter)
        self.cost += cost
        if letter != "I":
            if fault:
                self.count[fault] += 1
            if self.before is not None and self.before + old[:1] not in LEGAL:
                self.illegal += 1
            self.before = old[:1]
            if turn is not None:
                # turns ascend, so a new one differs from the last
                self.distinct += turn != self.turn
                self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn
        if role is not None:
            self.hash.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
            self.lines += 1

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return self.conv, gaps, *self.count.values(), self.illegal, self.cost, "".join(self.letters), self.hash.hexdigest()


def _digest_batches(batches: Iterator[pa.RecordBatch], costs: Costs) -> Iterator[pa.RecordBatch]:
    rows, now = [], None
    for conv, _, letter, *rest in _edits(batches, costs):
        if now is None or conv != now.conv:
            if now is not None:
                rows.append(now.row())
            now = Digest(conv)
        if letter is not None:
            now.take(letter, *rest)
        if len(rows) >= OUT_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), DIGESTS.types, strict=True)], schema=DIGESTS)
            rows = []
    if now is not None:
        rows.append(now.row())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), DIGESTS.types, strict=True)], schema=DIGESTS)


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with faults made on purpose, by crc32 of ``conv_id:turn`` modulo 20; nulls in any column read as a space.

    0 drops the row, 1 empties its text, 2 takes ``. ! ?`` out of it, 3 repeats it, 4 makes it a user's. Returns
    ``(conv_id, turn, role, text, there)``; a dropped row stays with ``there`` false, so its conversation is not lost.
    """
    def space(c: str):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"),
        space("text").alias("text"), kind.alias("_kind"),
    )
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    rows = rows.withColumns({"text": text, "role": role, "there": F.col("_kind") != 0})
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", "role", "text", "there", copies.alias("_copy")).drop("_copy")


def _sorted(rows: DataFrame) -> DataFrame:
    """Rows of a conversation together, by turn (null first), role and text, with ``again`` where an earlier turn has the same."""
    rows = rows.withColumns({
        "_same": F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256),
        "_when": F.struct(F.col("turn").isNotNull(), F.col("turn")),
    })
    # combined before the shuffle; only what occurs in several turns is left
    several = rows.where("there").groupBy(F.col("conv_id").alias("_conv"), F.col("_same").alias("_what")).agg(
        F.min("_when").alias("_first"), F.max("_when").alias("_last")
    )
    several = several.where(F.col("_first") != F.col("_last")).drop("_last")
    marked = rows.join(several, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_same") == F.col("_what")), "left")
    marked = marked.withColumn("again", F.coalesce(F.col("_when") > F.col("_first"), F.lit(False)))
    return (
        marked.select("conv_id", "turn", "role", "text", "there", "again").repartition("conv_id")
        .sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    )


def edits(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """Cheapest edits of every conversation, one row each, in the order of ``step``.

    ``rows`` has ``(conv_id, turn, role, text)`` and, where rows were dropped, ``there``. Gives the edit (K keep, R give
    another role, D delete, I insert), its ``cost``, of the edited row ``turn``, ``old_role`` and ``fault`` (blank,
    duplicate, truncated or empty, the first that holds), and ``role`` and ``text`` of the repaired turn, null where it
    is deleted. Of equally cheap edits those whose letters read least are taken.

    A null role or text is one space; rows of one turn are ordered by role and text; rows without a conversation are one
    conversation of their own; an empty role has no initial and can only get another role or go. A conversation whose
    rows are all dropped gives one row without an edit. Other columns are not read; an empty table gives no rows.
    """
    return _sorted(_wanted(rows)).mapInArrow(lambda batches: _edit_batches(batches, costs), EDITS_SQL)


def _wanted(rows: DataFrame) -> DataFrame:
    there = F.col("there") if "there" in rows.columns else F.lit(True)
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], F.coalesce(there, F.lit(True)).alias("there"),
    )


def digests(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """What :func:`edits` finds, one row per conversation: missing turn numbers (``gaps``), faulty rows by first fault,
    pairs of neighbours in no legal order (``illegal``), total ``cost``, the letters (``audit``) and a hash of the result.

    A conversation whose rows are all dropped has zeros, no letters and the hash of the empty string.
    """
    return _sorted(_wanted(rows)).mapInArrow(lambda batches: _digest_batches(batches, costs), DIGESTS_SQL)

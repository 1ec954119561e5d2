"""Repair of the turn structure of conversations at least cost.

The rows of a conversation, in order, are edited so that their roles read
``(system? (user assistant)+)?``: a row is kept (0), given the role that is due (3) or
deleted (4), and an empty turn of the role that is due can be inserted anywhere (3).  Blank
and repeated rows have to be deleted; a truncated row that stays costs 3 more.

This is a weighted automaton with one state per place in the grammar (`STARTS`), and it is
determinised lazily.  A conversation is scanned from its last row to its first: the vector
of the costs to go from every place, less its smallest entry, is a state of the
deterministic automaton, and a table keeps, for (state, kind of row), the next state and
what was subtracted.  Costs are bounded against each other by the price of insertions, so
there are few states, and after some rows a scan is a lookup per row.  The least cost is
what was subtracted in all plus the last vector's entry of the start.

The audit is traced back over the scanned states, which is from the first row to the last,
along arcs that are tight (the cost to go before equals the arc's cost and the cost to go
after).  Where several arcs are tight the least letter is taken; as one letter leads from
one place to one place only, this gives the ASCII-least of all cheapest audits.  The traced
pieces are kept in a table by (state, kind of row, place), too.

A conversation's rows are sorted by Spark and streamed through a task in Arrow batches.
While it is diagnosed, a row is 30 bytes without its text; while it is repaired, a
conversation's audit (a letter per edit) is held and its rows are passed on one batch after
another, so that the length of a conversation bounds neither.

Definitions: rows are ordered by turn (nulls first), rows of one turn by role and then by
hashes of role and text.  Null roles and texts are one space; a null conv_id is a
conversation of its own.  Texts are compared by two 64-bit hashes.  An empty table has no
conversations; other columns are not read.  A gap beyond 64 bits is the largest long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmill.llm.textkeys import as_array, lean
from trailmill.session import bounded_batches, cut

WHITE = " \t\n\x0b\x0c\r"
#: Places in the grammar: nothing yet, after the system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
STARTS = (START, SYSTEM, USER, ASSISTANT)
#: The place that a turn of the role that is due leads to.
DUE = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Initials of roles; any other is 3.
INITIALS = {"s": 0, "u": 1, "a": 2}
#: Kinds of rows: 0 has to go, else 1 + 2 * initial + truncated.
GO = 0
MOST = (1 << 63) - 1


def kept_place(place: int, initial: int) -> int | None:
    """Where keeping a row of this initial leads, if it is allowed."""
    if initial == INITIALS["s"]:
        return SYSTEM if place == START else None
    if initial == INITIALS["u"]:
        return USER if DUE[place] == USER else None
    return ASSISTANT if initial == INITIALS["a"] and DUE[place] == ASSISTANT else None


class Determinised:
    """Cost-to-go vectors as states, found when they are first met, and what was traced between them."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.names: dict[tuple[int, ...], int] = {}
        self.moves: dict[tuple[int, int], tuple[int, int]] = {}
        self.arcs: dict[tuple[int, int, int], tuple[str, int]] = {}
        self.end, self.end_cost = self._state(self._with_inserts([0, None, None, 0]))

    @staticmethod
    def _with_inserts(costs: list) -> list[int]:
        for _ in STARTS:
            for place in STARTS:
                after = costs[DUE[place]]
                if after is not None and (costs[place] is None or after + INSERT < costs[place]):
                    costs[place] = after + INSERT
        return costs

    def _state(self, costs: list[int]) -> tuple[int, int]:
        least = min(costs)
        vector = tuple(c - least for c in costs)
        if vector not in self.names:
            self.names[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.names[vector], least

    @staticmethod
    def _edits(place: int, kind: int):
        """(letter, cost, next place) of the edits that take the next row, in the order of their letters."""
        yield "D", DELETE, place
        if kind != GO:
            initial, truncated = divmod(kind - 1, 2)
            more = TRUNCATED * truncated
            to = kept_place(place, initial)
            if to is not None:
                yield "K", KEEP + more, to
            yield "R", REROLE + more, DUE[place]

    def move(self, state: int, kind: int) -> tuple[int, int]:
        """The state before a row of this kind, and what was subtracted."""
        found = self.moves.get((state, kind))
        if found is None:
            after = self.vectors[state]
            costs = [min(cost + after[to] for _, cost, to in self._edits(place, kind)) for place in STARTS]
            found = self.moves[state, kind] = self._state(self._with_inserts(costs))
        return found

    def arc(self, state: int, kind: int, place: int) -> tuple[str, int]:
        """Letters up to the one that takes the next row, and the place after it; `state` is the one after the row."""
        found = self.arcs.get((state, kind, place))
        if found is None:
            before, subtracted = self.move(state, kind)
            now, after = self.vectors[before], self.vectors[state]
            tight = [(letter, to) for letter, cost, to in self._edits(place, kind) if now[place] + subtracted == cost + after[to]]
            if now[place] == INSERT + now[DUE[place]]:
                tight.append(("I", DUE[place]))
            letter, to = min(tight)
            if letter == "I":
                rest, to = self.arc(state, kind, to)
                letter += rest
            found = self.arcs[state, kind, place] = letter, to
        return found

    def cheapest(self, kinds: list[int]) -> tuple[int, str]:
        """Least cost and ASCII-least audit of a conversation's kinds of rows."""
        state, cost, states = self.end, self.end_cost, []
        for kind in reversed(kinds):
            states.append(state)
            state, subtracted = self.move(state, kind)
            cost += subtracted
        cost += self.vectors[state][START]
        place, out = START, []
        for kind in kinds:
            letters, place = self.arc(states.pop(), kind, place)
            out.append(letters)
        end = self.vectors[self.end]
        while end[place]:
            place = DUE[place]
            out.append("I")
        return cost, "".join(out)


# --- streams of sorted rows -----------------------------------------------


def _changes(column: pa.Array) -> np.ndarray:
    """Places in a column whose value (or null) is another than the one before."""
    if len(column) < 2:
        return np.zeros(0, np.int64)
    a, b = column.slice(0, len(column) - 1), column.slice(1)
    other = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_null(a), pc.is_null(b)))
    return np.flatnonzero(other.to_numpy(zero_copy_only=False)) + 1


def _same(a: pa.Scalar, b: pa.Scalar) -> bool:
    return a.as_py() == b.as_py()


def whole_groups(batches, key: str):
    """Tables of whole groups (with the places where they begin) from batches that are sorted by `key`."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = batch.column(key)
        starts = np.concatenate([[0], _changes(keys)]).astype(np.int64)
        if held and not _same(held[0].column(key)[0], keys[0]):
            yield pa.Table.from_batches(held), np.zeros(1, np.int64)
            held = []
        if len(starts) == 1:
            held.append(batch)
            continue
        last = int(starts[-1])
        done = pa.Table.from_batches([*held, batch.slice(0, last)])
        before = sum(b.num_rows for b in held)
        yield done, np.concatenate([starts[:1], starts[1:-1] + before])
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held), np.zeros(1, np.int64)


def _diagnose(batches):
    automaton = Determinised()
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    for table, starts in whole_groups(batches, "conv_id"):
        n = table.num_rows
        column = lambda name: as_array(table.column(name))
        blank, open_end = (column(c).to_numpy(zero_copy_only=False) for c in ("blank", "open_end"))
        initial, h1, h2 = (column(c).to_numpy() for c in ("initial", "h1", "h2"))
        group = np.zeros(n, np.int64)
        group[starts[1:]] = 1
        group = np.cumsum(group)
        order = np.lexsort((np.arange(n), h2, h1, group))
        again = (group[order][1:] == group[order][:-1]) & (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
        repeated = np.zeros(n, bool)
        repeated[order[1:][again]] = True
        repeated &= ~blank
        cut_off = open_end & ~blank & ~repeated
        kinds = np.where(blank | repeated, GO, 1 + 2 * initial + cut_off)
        pair = initial[:-1] * 4 + initial[1:]  # su, ua and au are legal
        wrong = np.ones(n, bool)
        wrong[1:] = ~np.isin(pair, (0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1))
        wrong[starts] = False
        turn = column("turn")
        values, has = turn.fill_null(0).to_numpy(), turn.is_valid().to_numpy(zero_copy_only=False)
        fresh = has.copy()
        fresh[1:] &= (values[1:] != values[:-1]) | ~has[:-1] | (group[1:] != group[:-1])
        ends = np.append(starts[1:], n)
        sums = [np.add.reduceat(x.astype(np.int64), starts) for x in (blank, repeated, cut_off, wrong, fresh, has)]
        rows = []
        for k, (a, b) in enumerate(zip(starts, ends)):
            cost, audit = automaton.cheapest(kinds[a:b].tolist())
            gaps = 0
            if sums[5][k]:  # nulls come first
                gaps = min(MOST, int(values[b - 1]) - int(values[b - sums[5][k]]) + 1 - int(sums[4][k]))
            rows.append((gaps, cost, audit))
        ids = column("conv_id").take(pa.array(starts))
        columns = [ids, pa.array([r[0] for r in rows], pa.int64()), *map(pa.array, sums[:4]), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows])]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _clean(rows: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    return plain.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64("text", "role", F.lit(1))})


ORDER = ("turn", "role", "h1", "h2")


def diagnose(rows: DataFrame) -> DataFrame:
    """One row per conversation of `rows` (conv_id, turn, role, text): what is wrong, the least cost of its repair and the edits.

    `gaps` counts the turns missing between the first and the last, `blank`, `duplicate` and
    `truncated` each row's first fault, `illegal` neighbours that may not follow each other,
    `cost` and `audit` (letters K, R, D and I in order) are the cheapest repair's.
    """
    bounded_batches(rows.sparkSession)
    words = F.rtrim(F.col("text"), F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    code = F.lit(3)
    for letter, k in INITIALS.items():
        code = F.when(initial == letter, F.lit(k)).otherwise(code)
    flags = [(words == "").alias("blank"), (~F.right(words, F.lit(1)).isin(".", "!", "?")).alias("open_end"), code.cast("int").alias("initial")]
    slim = _clean(rows).select("conv_id", *ORDER, *flags)
    dealt = slim.repartition("conv_id").sortWithinPartitions("conv_id", *ORDER).drop("role")
    kind = rows.schema["conv_id"].dataType.simpleString()
    return dealt.mapInArrow(lean(_diagnose), f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def _edited(batches):
    names = ["conv_id", "place", "turn", "role", "text", "edit"]
    conv, audit, at, place, row = None, "", 0, START, 0
    out: tuple[list, ...] = ([], [], [], [], [], [])
    size = 0

    def put(*values):
        for column, value in zip(out, values):
            column.append(value)

    def inserts():
        nonlocal at, place, row
        while at < len(audit) and audit[at] == "I":
            place = DUE[place]
            put(conv, row, None, NAMES[place], "", "I")
            at, row = at + 1, row + 1

    for batch in batches:
        types = [batch.schema.field("conv_id").type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for key, edits, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "turn", "role", "text"))):
            if edits is not None:  # a conversation begins
                conv, audit, at, place, row = key, edits, 0, START, 0
                inserts()
                continue
            letter = audit[at]
            at += 1
            if letter == "K":
                place = kept_place(place, INITIALS.get(role[:1], 3))
            elif letter == "R":
                place = DUE[place]
                role = NAMES[place]
            if letter != "D":
                put(conv, row, turn, role, text, letter)
                size, row = size + len(text), row + 1
            inserts()
            if size > 4 << 20 or len(out[0]) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)
                out, size = ([], [], [], [], [], []), 0
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)
            out, size = ([], [], [], [], [], []), 0


def repair(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations of `rows`, given what `diagnose` found: conv_id, place (from 0), turn, role, text and edit.

    Inserted turns have no turn number and an empty text.  All rows of a conversation lie in
    one partition, in order.
    """
    bounded_batches(rows.sparkSession)
    texts = _clean(rows).withColumn("audit", F.lit(None).cast("string"))
    heads = found.select("conv_id", "audit")
    both = texts.unionByName(heads, allowMissingColumns=True)
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), *ORDER)
    kind = rows.schema["conv_id"].dataType.simpleString()
    return dealt.select("conv_id", "audit", "turn", "role", "text").mapInArrow(lean(_edited), f"conv_id {kind}, place long, turn long, role string, text string, edit string")


def _digest(batches):
    conv, hasher, before = None, None, False
    for batch in batches:
        keys, shas = [], []
        for key, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text"))):
            if place == 0:
                if before:
                    keys.append(conv)
                    shas.append(hasher.hexdigest())
                conv, hasher, before = key, hashlib.sha256(), True
            else:
                hasher.update(b"\n")
            hasher.update(f"{role}:{text}".encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field("conv_id").type), pa.array(shas, pa.string())], names=["conv_id", "sha256"])
        kind = batch.schema.field("conv_id").type
    if before:
        yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([hasher.hexdigest()])], names=["conv_id", "sha256"])


def digests(repaired: DataFrame) -> DataFrame:
    """SHA-256 of every conversation of `repair`'s result as it lies: `role:text`, joined by newlines."""
    kind = repaired.schema["conv_id"].dataType.simpleString()
    return repaired.mapInArrow(lean(_digest), f"conv_id {kind}, sha256 string")


def repaired_digests(rows: DataFrame) -> DataFrame:
    """One row per conversation: `diagnose`'s columns and `repaired_sha256`."""
    found = cut(diagnose(rows), "diagnosed")
    done = digests(repair(rows, found)).select(F.col("conv_id").alias("_id"), F.col("sha256").alias("_sha"))
    joined = found.join(done, F.col("conv_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    return joined.withColumn("repaired_sha256", F.coalesce("_sha", F.sha2(F.lit(""), 256))).drop("_sha")

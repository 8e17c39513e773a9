"""Conversation structure repair by depth-first branch and bound.

A conversation shall read ``(s?(ua)+)?`` in initials of its roles. Rows are kept (K, free), given
another role (R, 3), deleted (D, 4; a must for blank and repeated ones) or inserted (I, 3); a
truncated row that stays adds 3. Sought is the cheapest list of edits, of equally cheap ones the
ASCII-least audit (their letters in order).

The search keeps open prefixes on a stack of its own, the most promising on top. A prefix is
given up if its cost and a lower bound of the rest exceed the best found so far (cost, audit),
or if they are equal and its letters are greater; and if its node (rows done, state) was
reached by a cheaper prefix, or as cheaply with lesser letters. Two equally cheap prefixes of a
node never begin one another, since only I's could follow and these cost, so the lesser one
stays the lesser whatever follows. The bound adds up what rows cost in any case and one edit for
each of the disjoint neighbours that may not stand side by side. An empty stack proves the best.

A conversation may be of any length. All rows are range sorted by (conv_id, turn, role, text),
so one that holds a third of all rows spreads over many tasks, and cut into segments of SEGMENT
rows. A segment is searched for each state it may begin in and end in; the few best lists of the
segments of a conversation are then put together in order, by the same comparison.

Rows are taken by turn (nulls first), of equal turns by role, then text. Null roles and texts
count as one space. Repeated rows are counted before they are moved, and stand side by side. A
row without conv_id belongs to the conversation null. Rows with ``copies`` 0 only make their
conversation appear; one without rows has zeros and an empty audit. Empty tables give empty
results. Extra columns are ignored. A segment ends after SEGMENT_BYTES of text, so a very long
text is held alone."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..staging import stage

SEGMENT, SEGMENT_BYTES = 64, 1 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SPACES = " \t\n\x0b\x0c\r"
#: Characters of a text by which rows of one turn and role are dealt to tasks.
DEALT = 64
#: States by the role that came last; START before any.
START, S, U, A = range(4)
LETTER = {S: "s", U: "u", A: "a"}
AFTER = {START: {"s": S, "u": U}, S: {"u": U}, U: {"a": A}, A: {"u": U}}
NEXT = {START: U, S: U, U: A, A: U}
NAMES = {U: "user", A: "assistant"}
LEGAL = {"su", "ua", "au"}


class Item(NamedTuple):
    """A row that may stay (``forced`` 0), or a run of rows that must be deleted."""

    initial: str
    truncated: bool
    forced: int


Found = tuple[int, str]


class Search:
    """All searches over the items of one segment share its bounds."""

    def __init__(self, items: list[Item]):
        self.items = items
        n = len(items)
        #: what the items from each place on cost in any case
        self.surely = [0] * (n + 1)
        for i in range(n - 1, -1, -1):
            item = items[i]
            self.surely[i] = self.surely[i + 1] + (DELETE * item.forced if item.forced else TRUNCATED * item.truncated)

    def _least_edit(self, *at: int) -> int:
        """The least that an edit of one of these rows, or an insertion beside them, adds."""
        spared = DELETE - TRUNCATED
        return min([INSERT, REROLE, *[spared if self.items[i].truncated else DELETE for i in at]])

    def _bounds(self, goal: int) -> tuple[list[int], list[int]]:
        """For each place: the edits that disjoint clashing neighbours from there on need; and
        the first row from there on that may stay (-1 for none)."""
        n = len(self.items)
        clashes, first = [0] * (n + 1), [-1] * (n + 1)
        for i in range(n - 1, -1, -1):
            clashes[i], first[i], later = clashes[i + 1], first[i + 1], first[i + 1]
            if self.items[i].forced:
                continue
            first[i], here = i, self.items[i].initial
            if later < 0:
                pair, rest = (self._least_edit(i) if here != LETTER[goal] else 0), 0
            else:
                pair, rest = (0 if here + self.items[later].initial in LEGAL else self._least_edit(i, later)), clashes[later + 1]
            clashes[i] = max(clashes[i], pair + rest)
        return clashes, first

    def best(self, start: int, goal: int, incumbent: Found | None = None) -> Found | None:
        """The cheapest edits from state ``start`` to ``goal``, ASCII-least of these, unless
        ``incumbent`` is better."""
        if goal == START:
            if start != START:
                return incumbent
            number = sum(item.forced or 1 for item in self.items)
            every = (DELETE * number, "D" * number)
            return min(every, incumbent or every)
        items, n = self.items, len(self.items)
        clashes, first = self._bounds(goal)

        def least(i: int, q: int) -> int:
            at = first[i]
            if at < 0:
                return self.surely[i] + (0 if q == goal else INSERT)
            own = 0 if items[at].initial in AFTER[q] else self._least_edit(at) + clashes[at + 1]
            return self.surely[i] + max(clashes[i], own)

        reached: dict[tuple[int, int], Found] = {}
        stack = [(0, 0, start, "")]
        while stack:
            cost, i, q, audit = stack.pop()
            if goal == S and q > S:
                continue  # no way back
            if incumbent is not None:
                low = cost + least(i, q)
                if low > incumbent[0] or low == incumbent[0] and audit > incumbent[1][: len(audit)]:
                    continue
            seen = reached.get((i, q))
            if seen is not None and seen <= (cost, audit):
                continue
            reached[i, q] = cost, audit
            if i == n and q == goal:
                if incumbent is None or (cost, audit) < incumbent:
                    incumbent = cost, audit
                continue
            ways = [(cost + INSERT, i, NEXT[q], audit + "I")]
            if i < n:
                item = items[i]
                if item.forced:
                    ways.append((cost + DELETE * item.forced, i + 1, q, audit + "D" * item.forced))
                else:
                    stay = cost + TRUNCATED * item.truncated
                    ways.append((cost + DELETE, i + 1, q, audit + "D"))
                    if item.initial in AFTER[q]:
                        ways.append((stay + KEEP, i + 1, AFTER[q][item.initial], audit + "K"))
                    ways.append((stay + REROLE, i + 1, NEXT[q], audit + "R"))
            ways.sort(key=lambda w: (w[0] + least(w[1], w[2]), w[3]), reverse=True)
            stack += ways
        return incumbent


def apply(rows: list[tuple[str, str, int]], start: int, audit: str) -> list[tuple[str, str]]:
    """role, text of the rows (role, text, copies) after the edits ``audit``."""
    out, q, at, used = [], start, 0, 0
    for letter in audit:
        if letter == "I":
            q = NEXT[q]
            out.append((NAMES[q], ""))
            continue
        role, text, copies = rows[at]
        if letter == "K":
            q = AFTER[q][role[:1]]
            out.append((role, text))
        elif letter == "R":
            q = NEXT[q]
            out.append((NAMES[q], text))
        used += 1
        if used == copies:
            at, used = at + 1, 0
    return out


# Rows


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies after the damage that crc32 of ``conv_id:turn`` modulo
    20 names: 0 drops a row (copies 0), 1 empties its text, 2 removes its ``.!?``, 3 repeats it
    (copies 2), 4 sets role user. Nulls count as one space."""
    space = F.lit(" ")
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind, text = F.crc32(named) % 20, F.coalesce("text", space)
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _counted(rows: DataFrame) -> DataFrame:
    """Different rows with copies, and what is wrong with each; ``first`` where its role and
    text were not seen in an earlier turn. Dropped rows of a conversation become one."""
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    rows = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), F.greatest(F.coalesce(copies.cast("long"), F.lit(1)), F.lit(0)).alias("copies"),
    )
    none = F.col("copies") == 0
    rows = rows.select("conv_id", *[F.when(~none, F.col(c)).alias(c) for c in ("turn", "role", "text")], "copies")
    rows = stage(rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")))
    # 128 bits stand for role and text
    mark = [F.xxhash64("role", "text"), F.xxhash64("text", F.lit("turn"), "role")]
    marked = rows.select("*", mark[0].alias("_a"), mark[1].alias("_b"), F.struct(F.col("turn").isNotNull(), "turn").alias("_when"))
    firsts = marked.groupBy(F.col("conv_id").alias("_conv"), F.col("_a").alias("_c"), F.col("_b").alias("_d")).agg(F.min("_when").alias("_first"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_a") == F.col("_c")) & (F.col("_b") == F.col("_d"))
    joined = marked.hint("merge").join(firsts, same)
    solid = F.rtrim(F.col("text"), F.lit(SPACES))
    return joined.select(
        "conv_id", "turn", "role", "text", "copies", F.col("_when").eqNullSafe(F.col("_first")).alias("first"),
        (solid == "").alias("blank"), (~F.right(solid, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
    )


# Segments

COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
BEST = "array<struct<start: int, goal: int, cost: long, audit: string>>"


class _Segment:
    """Rows of one conversation that follow each other."""

    def __init__(self, conv):
        self.conv, self.rows, self.items, self.bytes = conv, [], [], 0
        self.count = dict.fromkeys(COUNTS, 0)
        self.low = self.high = None
        self.head = self.tail = None

    def add(self, turn, role, text, copies, first, blank, truncated) -> None:
        if copies == 0:
            return
        initial = role[:1]
        if self.rows:
            self.count["illegal"] += self.tail + initial not in LEGAL
        else:
            self.head = initial
        self.tail = initial
        self.count["illegal"] += (copies - 1) * (initial * 2 not in LEGAL)
        if turn is not None and turn != self.high:
            self.count["turns"] += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.rows.append((role, text, copies))
        self.bytes += len(text)
        stays = first and not blank
        if stays:
            self.items.append(Item(initial, truncated, 0))
            self.count["truncated"] += truncated
        gone = copies - stays
        self.count["blank" if blank else "duplicate"] += gone
        if gone and self.items and self.items[-1].forced:
            gone += self.items.pop().forced
        if gone:
            self.items.append(Item("", False, gone))

    def full(self, rows: int) -> bool:
        return len(self.rows) >= rows or self.bytes >= SEGMENT_BYTES

    def found(self, begins: bool, ends: bool) -> list[dict]:
        """The best edits for each state in which the segment may begin and end."""
        search, out = Search(self.items), []
        for start in (START,) if begins else range(4):
            best = None
            for goal in (START, A) if ends else range(4):
                best = search.best(start, goal, best if ends else None)
                if best is not None and not ends:
                    out.append({"start": start, "goal": goal, "cost": best[0], "audit": best[1]})
            if ends:
                # one of both goals, whichever is better
                out.append({"start": start, "goal": A, "cost": best[0], "audit": best[1]})
        return out

    def row(self, at: int, begins: bool, ends: bool) -> dict:
        rows = [{"role": r, "text": t, "copies": c} for r, t, c in self.rows]
        edges = {"low": self.low, "high": self.high, "head": self.head, "tail": self.tail}
        return {"conv_id": self.conv, "at": at, "rows": rows, "best": self.found(begins, ends), **edges, **self.count}


def _segments(schema: pa.Schema, rows: int):
    """Over partitions sorted by conversation and place. A conversation that is neither the
    first nor the last of its partition is whole in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 33, [], 0
        segment, whole = None, False  # whole: the conversation begins in this partition

        def done(ends: bool) -> None:
            nonlocal number, size
            held.append(segment.row(number, whole and segment.begins, ends))
            number += 1
            size += segment.bytes

        for batch in batches:
            for row in zip(*[column.to_pylist() for column in batch.columns]):
                if segment is None or segment.conv != row[0] or segment.full(rows):
                    other = segment is None or segment.conv != row[0]
                    if segment is not None:
                        done(other)
                        whole = whole or other
                    segment = _Segment(row[0])
                    segment.begins = other
                segment.add(*row[1:])
                if len(held) >= 256 or size >= SEGMENT_BYTES:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held, size = [], 0
        if segment is not None:
            done(False)
            yield pa.RecordBatch.from_pylist(held, schema)

    return run


# Whole conversations


class _Path:
    """Edits up to a segment; paths share what they have in common."""

    __slots__ = ("before", "start", "cost", "audit", "at")

    def __init__(self, before, start, cost, audit, at):
        self.before, self.start, self.cost, self.audit, self.at = before, start, cost, audit, at

    def better_than(self, other) -> bool:
        if other is None or self.cost != other.cost:
            return other is None or self.cost < other.cost
        a, b, one, two = [], [], self, other
        while one is not two:
            a.append(one.audit)
            b.append(two.audit)
            one, two = one.before, two.before
        return "".join(reversed(a)) < "".join(reversed(b))

    def steps(self) -> list:
        out, step = [], self
        while step.before is not None:
            out.append(step)
            step = step.before
        return out[::-1]


def _joined(schema: pa.Schema):
    """Over segments sorted by conversation and place: start and audit of each one, and with the
    last of a conversation its counts, cost and audit."""

    def conversation(conv, segments) -> Iterator[dict]:
        paths = {START: _Path(None, START, 0, "", None)}
        total = dict.fromkeys(COUNTS, 0)
        low = high = tail = None
        for s in segments:
            for c in COUNTS:
                total[c] += s[c]
            if s["head"] is not None:
                total["illegal"] += tail is not None and tail + s["head"] not in LEGAL
                tail = s["tail"]
            if s["low"] is not None:
                total["turns"] -= s["low"] == high
                low, high = s["low"] if low is None else low, s["high"]
            reached: dict[int, _Path] = {}
            for b in s["best"]:
                if b["start"] in paths:
                    before = paths[b["start"]]
                    path = _Path(before, b["start"], before.cost + b["cost"], b["audit"], s["at"])
                    if path.better_than(reached.get(b["goal"])):
                        reached[b["goal"]] = path
            paths = reached
        best = None
        for q in (START, A):
            if q in paths and paths[q].better_than(best):
                best = paths[q]
        steps = best.steps()
        none = dict.fromkeys((*COUNTS, "gaps", "cost", "whole"))
        for step in steps[:-1]:
            yield {"conv_id": conv, "at": step.at, "start": step.start, "audit": step.audit, **none}
        gaps = 0 if low is None else high - low + 1 - total["turns"]
        whole = "".join([step.audit for step in steps])
        last = steps[-1]
        yield {"conv_id": conv, "at": last.at, "start": last.start, "audit": last.audit, **total, "gaps": gaps, "cost": best.cost, "whole": whole}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        rows = (row for batch in batches for row in batch.to_pylist())
        for conv, segments in groupby(rows, key=lambda row: row["conv_id"]):
            for row in conversation(conv, segments):
                held.append(row)
                if len(held) >= 1024:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return run


def _edited(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                turns = apply([(r["role"], r["text"], r["copies"]) for r in row["rows"]], row["start"], row["audit"])
                if turns:
                    yield pa.RecordBatch.from_pylist(
                        [{"conv_id": row["conv_id"], "at": row["at"], "place": k, "role": r, "text": t} for k, (r, t) in enumerate(turns)], schema
                    )

    return run


class Repaired(NamedTuple):
    """``conversations``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.
    ``turns``: conv_id, at, place, role, text of the repaired rows, in the order of (at, place)."""

    conversations: DataFrame
    turns: DataFrame


def _with(conv: T.DataType, fields: str) -> T.StructType:
    return T.StructType([T.StructField("conv_id", conv), *T.StructType.fromDDL(fields).fields])


def repair(rows: DataFrame, segment: int = SEGMENT) -> Repaired:
    """Repair the conversations in ``rows`` (conv_id, turn, role, text, and copies if a row
    stands for several), at most ``segment`` rows at a time. Segments and edits are written
    when this is called."""
    conv = rows.schema["conv_id"].dataType
    counted = _counted(rows)
    order = ["conv_id", "turn", "role"]
    sorted_ = counted.repartitionByRange(*order, F.left("text", F.lit(DEALT))).sortWithinPartitions(*order, "text")
    held = _with(conv, f"at long, rows array<struct<role: string, text: string, copies: long>>, best {BEST}, low long, high long, "
                       f"head string, tail string, {', '.join(f'{c} long' for c in COUNTS)}")  # fmt: skip
    segments = stage(sorted_.mapInArrow(_segments(to_arrow_schema(held), segment), held))
    path = _with(conv, f"at long, start int, audit string, {', '.join(f'{c} long' for c in COUNTS)}, gaps long, cost long, whole string")
    tables = segments.drop("rows").repartition("conv_id").sortWithinPartitions("conv_id", "at")
    paths = stage(tables.mapInArrow(_joined(to_arrow_schema(path)), path))
    turn = _with(conv, "at long, place int, role string, text string")
    edits = segments.select("conv_id", "at", "rows").hint("merge").join(paths.select("at", "start", "audit"), "at")
    turns = edits.select("conv_id", "at", "rows", "start", "audit").mapInArrow(_edited(to_arrow_schema(turn)), turn)
    whole = paths.where("cost IS NOT NULL").select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", F.col("whole").alias("audit")
    )
    return Repaired(whole, turns)


def _digested(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
        held = []
        for conv, turns in groupby(rows, key=lambda row: row[0]):
            digest, between = hashlib.sha256(), b""
            for _, role, text in turns:
                digest.update(between + role.encode() + b":" + text.encode())
                between = b"\n"
            held.append({"conv_id": conv, "sha256": digest.hexdigest()})
            if len(held) >= 1024:
                yield pa.RecordBatch.from_pylist(held, schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return run


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, sha256 of the rows ``role:text`` of each conversation, joined by newlines. A
    conversation streams through its task; a digest takes bytes in order, so it is not split."""
    schema = _with(turns.schema["conv_id"].dataType, "sha256 string")
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "at", "place")
    return ordered.select("conv_id", "role", "text").mapInArrow(_digested(to_arrow_schema(schema)), schema)


def with_digests(repaired: Repaired) -> DataFrame:
    """The conversations with repaired_sha256, that of the empty text where nothing is left."""
    found = digests(repaired.turns).select(F.col("conv_id").alias("_conv"), "sha256")
    same: Column = F.col("conv_id").eqNullSafe(F.col("_conv"))
    joined = repaired.conversations.hint("merge").join(found, same, "left")
    return joined.select(*repaired.conversations.columns, F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))

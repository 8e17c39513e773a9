"""Conversation repair (op 12) against all lists of edits, and against a plain sweep."""

import hashlib
import heapq
import os
import random
import re
import zlib

import pytest

from tidelag.llm import turn_repair

SF = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
FULL = {"u": "user", "a": "assistant"}


def loop_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        named = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(named.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def loop_edits(rows):
    """(cost, audit, repaired) of rows (role, text, must go, truncated): the cheapest first, then
    by the letters, over states (rows done, last initial). Costs are never negative, and letters
    of equally cheap lists decide at the first difference."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, q, kept = heapq.heappop(heap)
        if i == len(rows) and q in ("", "a"):
            return cost, audit, kept
        if (i, q) in done:
            continue
        done.add((i, q))
        put = lambda *x: heapq.heappush(heap, x)
        put(cost + 3, audit + "I", i, NEXT[q], (*kept, f"{FULL[NEXT[q]]}:"))
        if i < len(rows):
            role, text, must, cut = rows[i]
            put(cost + 4, audit + "D", i + 1, q, kept)
            if not must:
                if role[:1] == NEXT[q] or (q == "" and role[:1] == "s"):
                    put(cost + 3 * cut, audit + "K", i + 1, role[:1], (*kept, f"{role}:{text}"))
                put(cost + 3 + 3 * cut, audit + "R", i + 1, NEXT[q], (*kept, f"{FULL[NEXT[q]]}:{text}"))


def every_edit(rows, most):
    """The same by trying all lists of edits of at most ``most`` insertions."""
    best = None

    def go(i, q, cost, audit, left):
        nonlocal best
        if i == len(rows) and q in ("", "a") and (best is None or (cost, audit) < best):
            best = cost, audit
        if left:
            go(i, NEXT[q], cost + 3, audit + "I", left - 1)
        if i < len(rows):
            role, text, must, cut = rows[i]
            go(i + 1, q, cost + 4, audit + "D", left)
            if not must:
                if role[:1] == NEXT[q] or (q == "" and role[:1] == "s"):
                    go(i + 1, role[:1], cost + 3 * cut, audit + "K", left)
                go(i + 1, NEXT[q], cost + 3 + 3 * cut, audit + "R", left)

    go(0, "", 0, "", most)
    return best


def loop_repair(damaged, every):
    out = {}
    for conv in every:
        rows = sorted([r[1:] for r in damaged if r[0] == conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [t for t, *_ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, faults, marked = set(), dict.fromkeys(("blank", "duplicate", "truncated"), 0), []
        for _, role, text in rows:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = None
            if not solid:
                fault = "blank"
            elif (role, text) in seen:
                fault = "duplicate"
            elif solid[-1] not in ".!?":
                fault = "truncated"
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, kept = loop_edits(marked)
        out[conv] = (gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def results(df):
    columns = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[c] for c in columns) for r in rows}


def made_up(rng, n):
    """Roles and texts with all faults."""
    texts = ["Yes.", "No?", "So be it", "", " \n", "Yes.", "Ünd!  \t", "a.b", "."]
    return [(rng.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]), rng.choice(texts) + rng.choice(["", "", f"{rng.randrange(9)}."])) for _ in range(n)]


@pytest.fixture(scope="module")
def conversations():
    rng, rows = random.Random(12), []
    for conv in [*range(90), None]:
        turn = rng.randrange(3)
        for role, text in made_up(rng, rng.choice([0, 1, 2, 5, 9, 30])):
            rows.append((conv, rng.choice([turn, turn, turn, None]), rng.choice([role] * 9 + [None]), rng.choice([text] * 9 + [None])))
            turn += rng.choice([1, 1, 1, 2, 0])
    rows += [(500, t, *r) for t, r in enumerate(made_up(rng, 700))]
    rows += [(501, None, "user", "same.")] * 60 + [(501, 3, "user", "same.")] * 5 + [(502, 7, None, None)]
    # every row of it is dropped
    rows += [(conv, 0, "user", "Hi.") for conv in range(600, 700) if zlib.crc32(f"{conv}:0".encode()) % 20 == 0]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("segment", [1, 3, turn_repair.SEGMENT])
def test_repair_equals_the_sweep(spark, conversations, segment):
    damaged = loop_damage(conversations)
    df = spark.createDataFrame(conversations, SCHEMA).selectExpr("*", "1 AS cost", "'x' AS `at`", "2 AS first").repartition(3)
    got = results(turn_repair.with_digests(turn_repair.repair(turn_repair.damage(df), segment)))
    assert got == loop_repair(damaged, {r[0] for r in conversations})
    assert sum(r[7] == hashlib.sha256(b"").hexdigest() for r in got.values()) > 3


def test_undamaged_rows_and_names(spark):
    """Without copies each row counts once; any type of conv_id; the repaired rows are there."""
    rows = [("x", 0, "user", "A?"), ("x", 0, "user", "A?"), ("x", 2, "assistant", "B."), ("y", 1, "assistant", "C")]
    found = turn_repair.repair(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string"))
    assert results(turn_repair.with_digests(found)) == loop_repair(rows, {"x", "y"})
    turns = found.turns.orderBy("conv_id", "at", "place").collect()
    assert [tuple(r)[::3] + (r.text,) for r in turns][:2] == [("x", "user", "A?"), ("x", "assistant", "B.")]


def test_empty(spark, nothing):
    empty = spark.createDataFrame([], SCHEMA)
    assert turn_repair.with_digests(turn_repair.repair(turn_repair.damage(empty))).count() == 0


def test_search_equals_every_list_of_edits():
    rng = random.Random(3)
    for _ in range(400):
        rows = []
        for role, _ in made_up(rng, rng.randrange(6)):
            must = rng.random() < 0.2
            rows.append((role, "t", must, not must and rng.random() < 0.3))
        items = [turn_repair.Item("" if m else r[:1], c, int(m)) for r, _, m, c in rows]
        search = turn_repair.Search(items)
        got = search.best(0, turn_repair.A, search.best(0, turn_repair.START))
        assert got == every_edit(rows, 4) == loop_edits(rows)[:2]


def test_bounds_hold():
    """No bound exceeds what the rest then costs."""
    rng = random.Random(5)
    for _ in range(300):
        items = [turn_repair.Item(rng.choice("suat"), rng.random() < 0.4, 0) if rng.random() < 0.8 else turn_repair.Item("", False, 2) for _ in range(8)]
        for i in range(8):
            rest = turn_repair.Search(items[i:])
            for start in range(4):
                for goal in (turn_repair.U, turn_repair.A):
                    assert rest.surely[0] + rest._bounds(goal)[0][0] <= rest.best(start, goal)[0]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_on_the_given_table(spark):
    from tidelag.llm import queries as llm

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert results(llm.queries()["op12_turn_repair"](spark, SF)) == loop_repair(loop_damage(rows), {r[0] for r in rows})

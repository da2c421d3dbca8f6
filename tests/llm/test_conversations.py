"""Conversation repair against exhaustive search, and on odd inputs."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from cohortaudit.llm import conversations as C
from cohortaudit.llm import queries

SF = "/root/testdata/sf0.001"
DDL = "conv_id long, turn long, role string, text string, row string, audit int, gaps int"


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        solid = [c for c in text if c not in "\x20\t\n\v\f\r"]
        out.append(1 if not solid else 2 if (role, text) in seen else 0 if solid[-1] in ".!?" else 3)
        seen.add((role, text))
    return out


def every_repair(rows):
    """(cost, audit, turns) over all edits, with up to two turns inserted at each place."""
    faults, best = faults_of(rows), None
    inserts = [seq for k in range(3) for seq in itertools.product(("user", "assistant"), repeat=k)]
    choices = [["D"] if f in (1, 2) else ["D", "K", "user", "assistant"] for f in faults]
    for picked in itertools.product(*choices):
        for added in itertools.product(inserts, repeat=len(rows) + 1):
            cost, audit, turns = 0, "", []
            for i, new in enumerate(added):
                cost, audit, turns = cost + 2 * len(new), audit + "I" * len(new), turns + [(r, "") for r in new]
                if i < len(rows):
                    p = picked[i]
                    audit += p if p in "DK" else "R"
                    cost += 3 if p == "D" else (faults[i] == 3) + 2 * (p != "K")
                    if p != "D":
                        turns.append((rows[i][0] if p == "K" else p, rows[i][1]))
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or " " for r, _ in turns)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, turns)
    return best


def cheapest(rows):
    """(cost, audit) in the order of (cost, audit), over states; for conversations too long for every_repair."""
    faults, initials = faults_of(rows), [r[:1] or " " for r, _ in rows]
    queue, done = [(0, "", 0, "")], set()
    while queue:
        cost, audit, i, state = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit
        ways = lambda x: {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[state].get(x)  # noqa: E731, B023
        for x in "ua":
            if ways(x):
                heapq.heappush(queue, (cost + 2, audit + "I", i, ways(x)))
        if i < len(rows):
            heapq.heappush(queue, (cost + 3, audit + "D", i + 1, state))
            if faults[i] not in (1, 2):
                cut = faults[i] == 3
                if ways(initials[i]):
                    heapq.heappush(queue, (cost + cut, audit + "K", i + 1, ways(initials[i])))
                for x in "ua":
                    if ways(x):
                        heapq.heappush(queue, (cost + cut + 2, audit + "R", i + 1, ways(x)))


def walk(rows, audit):
    state, out, i = "", [], 0
    for x in audit:
        role, text = rows[i] if x != "I" else ("", "")
        i += x != "I"
        if x == "D":
            continue
        if x != "K":
            role = {"": "user", "s": "user", "u": "assistant", "a": "user"}[state]
        state = role[0]
        out.append((role, text))
    return out


def digest(turns):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()


def brute(rows, repair=None):
    """The result's fields for (turn, role, text) rows in order."""
    plain = [(r, t) for _, r, t in rows]
    faults, known = faults_of(plain), [t for t, _, _ in rows if t is not None]
    illegal = sum((a[:1] or " ") + (b[:1] or " ") not in ("su", "ua", "au") for (a, _), (b, _) in zip(plain, plain[1:]))
    cost, audit = repair or cheapest(plain)
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, digest(walk(plain, audit)))


def damaged(conv, rows):
    out = []
    for turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        out += [] if k == 0 else [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_search_is_exhaustive():
    rng = random.Random(5)
    for _ in range(60):
        rows = [(rng.choice(["system", "user", "assistant", "tool", ""]), rng.choice(["a.", "b", " ", "c!"])) for _ in range(rng.randint(0, 3))]
        cost, audit, turns = every_repair(rows)
        assert C.search("".join(r[:1] or " " for r, _ in rows), bytes(faults_of(rows))) == (cost, audit)
        assert walk(rows, audit) == turns


def test_search_is_cheapest_and_first():
    rng = random.Random(7)
    for n in [*range(4, 30), 400]:
        rows = [(rng.choice(["system", "user", "assistant", "user", "assistant"]), rng.choice(["a.", "b", " ", f"c{rng.random()}!"])) for _ in range(n)]
        assert C.search("".join(r[0] for r, _ in rows), bytes(faults_of(rows))) == cheapest(rows)


def test_repair_of_odd_rows(spark):
    rng = random.Random(3)
    groups = {None: [(None, None, None), (1, "user", "x.")], 1: [(None, "user", "é?"), (5, "", "no role"), (7, "Assistant", "cut"), (7, "assistant", " ")], 2: [(1, "user", "a" * 300_000 + "."), (2, "assistant", "b" * 300_000)], 3: [(1, "user", "same."), (2, "user", "same."), (3, "user", "same."), (4, "assistant", "\n\t \v\f\r")]}
    groups |= {k: [(t, rng.choice(["user", "assistant", "system"]), rng.choice(["yes.", "no", "", "so!"])) for t in range(rng.randint(1, 9))] for k in range(10, 60)}
    frame = [(c, t, r, x, "row", 1, 2) for c, rows in groups.items() for t, r, x in rows]
    rng.shuffle(frame)
    frame = spark.createDataFrame(frame, DDL).repartition(5)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    got = {r.conv_id: r for r in C.repair(frame, with_turns=True).collect()}
    assert len(got) == len(groups)
    for c, rows in groups.items():
        plain = sorted([(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows], key=order)
        assert tuple(got[c][f] for f in FIELDS) == brute(plain), c
        assert digest([tuple(t) for t in got[c].turns]) == got[c].repaired_sha256
    for r in C.repair(C.damage(frame), copies_col="copies").collect():
        rows = sorted(damaged(r.conv_id, groups[r.conv_id]), key=order)
        assert tuple(r[f] for f in FIELDS) == brute(rows), r.conv_id


def test_all_dropped_and_empty(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    r = C.repair(C.damage(spark.createDataFrame([(gone, 0, "user", "x", "", 0, 0)], DDL)), copies_col="copies").collect()
    assert [tuple(x) for x in r] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert C.repair(C.damage(spark.createDataFrame([], DDL)), copies_col="copies").count() == 0


def test_one_long_conversation(spark):
    """A hundred thousand turns in one conversation: linear work, texts in a file."""
    rows = spark.range(100_000).selectExpr("1L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "concat(repeat('w', 300), id, if(id % 7 = 0, '', '.')) text")
    r = C.repair(rows).collect()
    assert len(r) == 1 and r[0].audit == "K" * 100_000 and r[0].cost == len(range(0, 100_000, 7)) == r[0].truncated


@pytest.mark.parametrize("sf", [SF])
def test_registered_query(spark, sf):
    groups = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        groups.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    got = {r.conv_id: tuple(r[f] for f in FIELDS) for r in queries.op13_conversations(spark, sf).collect()}
    assert got == {c: brute(damaged(c, sorted(rows))) for c, rows in groups.items()}

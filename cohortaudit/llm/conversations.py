"""Conversation structure repair: depth-first branch-and-bound over edits of the turns.

Spark deals the turns by conversation and sorts them; a task then walks through its
conversations one after the other. The search keeps an explicit stack, bounds what is
left by the cheapest completion of each suffix, holds an incumbent (cost, audit) and,
for each node (turns done, state), the least cost that has reached it.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from tempfile import SpooledTemporaryFile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortaudit.llm.common import map_rows

#: What the role initials so far make of the grammar (s?(ua)+)?
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a turn's initial leads, and what an inserted or re-roled turn has to become.
STEP = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
WANTED = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
ENDS = (START, ASSISTANT)
DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
SPACE, STOPS = "\x20\t\n\v\f\r", ".!?"
#: Bytes of a conversation's texts that stay in memory; longer ones wait in a file of the task.
HELD = 1 << 24
FAR = 1 << 30


def suffix_bounds(initials: str, faults: bytes) -> array:
    """At 4 * i + state: the least that turns i and later can cost from the state, its ending included."""
    n = len(faults)
    bounds = array("q", bytes(32 * (n + 1)))
    after = (0, FAR, FAR, 0)
    for i in range(n, -1, -1):
        if i == n:
            here = list(after)
        else:
            fault, initial = faults[i], initials[i]
            here = [DELETE + x for x in after]
            if fault not in (BLANK, DUPLICATE):
                cut = CUT * (fault == TRUNCATED)
                for state in range(4):
                    kept = STEP[state].get(initial)
                    here[state] = min(here[state], cut + REROLE + after[WANTED[state]], FAR if kept is None else cut + after[kept])
        # inserted turns lead from state to state before turn i
        here[USER], here[ASSISTANT] = min(here[USER], INSERT + here[ASSISTANT]), min(here[ASSISTANT], INSERT + here[USER])
        here[START], here[SYSTEM] = (min(here[s], INSERT + here[USER]) for s in (START, SYSTEM))
        bounds[4 * i : 4 * i + 4] = array("q", here)
        after = here
    return bounds


def _edits(i: int, state: int, initials: str, faults: bytes) -> list[tuple[str, int, int, int]]:
    """(letter, cost, turns done, state) of the edits at a node, in the order of their letters."""
    out = []
    if i < len(faults):
        out.append(("D", DELETE, i + 1, state))
    out.append(("I", INSERT, i, WANTED[state]))
    if i < len(faults) and faults[i] not in (BLANK, DUPLICATE):
        cut, kept = CUT * (faults[i] == TRUNCATED), STEP[state].get(initials[i])
        if kept is not None:
            out.append(("K", cut, i + 1, kept))
        out.append(("R", cut + REROLE, i + 1, WANTED[state]))
    return out


def search(initials: str, faults: bytes) -> tuple[int, str]:
    """The cheapest edits (cost, letters); of equal costs the letters that come first.

    A dive along the bounds gives the first incumbent. The stack then visits edits in the
    order of their letters, so a later way to the same node with the same cost can only
    have later letters: the least cost of a node is its whole dominance table. A node is
    left as soon as its cost and its bound exceed the incumbent, or equal it once the
    incumbent itself comes from the search.
    """
    n, bounds = len(faults), suffix_bounds(initials, faults)
    i, state, spent, dive = 0, START, 0, []
    while i < n or state not in ENDS:
        letter, cost, i, state = min(_edits(i, state, initials, faults), key=lambda e: (e[1] + bounds[4 * e[2] + e[3]], e[0] == "I"))
        spent += cost
        dive.append(letter)
    best, limit = (spent, "".join(dive)), spent + 1
    reached = array("q", [FAR]) * (4 * (n + 1))
    path: list[str] = []
    stack = [(0, "", 0, 0, START)]
    while stack:
        depth, letter, spent, i, state = stack.pop()
        if spent + bounds[4 * i + state] >= limit or spent >= reached[4 * i + state]:
            continue
        reached[4 * i + state] = spent
        if depth:
            del path[depth - 1 :]
            path.append(letter)
        if i == n and state in ENDS:
            best, limit = (spent, "".join(path)), spent
            continue
        for letter, cost, j, to in reversed(_edits(i, state, initials, faults)):
            if spent + cost + bounds[4 * j + to] < limit and spent + cost < reached[4 * j + to]:
                stack.append((depth + 1, letter, spent + cost, j, to))
    return best


class Conversation:
    """The turns of one conversation, in order; texts beyond HELD bytes lie in a file until it is done."""

    def __init__(self):
        self.initials, self.faults, self.seen = [], bytearray(), set()
        self.texts, self.sizes = SpooledTemporaryFile(max_size=HELD), array("q")
        self.low = self.high = self.last = None
        self.distinct = self.illegal = 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        raw_role, raw = role.encode(), text.encode()
        sign = hashlib.blake2b(b"%d:%s%s" % (len(raw_role), raw_role, raw), digest_size=16).digest()
        solid = text.rstrip(SPACE)
        fault = BLANK if not solid else DUPLICATE if sign in self.seen else SOUND if solid[-1] in STOPS else TRUNCATED
        self.seen.add(sign)
        initial = role[:1] or " "
        self.illegal += bool(self.initials) and self.initials[-1] + initial not in ("su", "ua", "au")
        self.initials.append(initial)
        self.faults.append(fault)
        self.sizes.extend((len(raw_role), len(raw)))
        self.texts.write(raw_role + raw)
        if turn is not None:
            self.distinct += self.last != turn
            self.low = turn if self.low is None else self.low
            self.high = self.last = turn

    def repaired(self, audit: str) -> Iterator[tuple[bytes, bytes]]:
        """(role, text) of each turn after the edits."""
        self.texts.seek(0)
        state, i = START, 0
        for letter in audit:
            role = text = b""
            if letter != "I":
                role, text = self.texts.read(self.sizes[2 * i]), self.texts.read(self.sizes[2 * i + 1])
                initial, i = self.initials[i], i + 1
            if letter == "D":
                continue
            if letter == "K":
                state = STEP[state][initial]
            else:
                state = WANTED[state]
                role = ROLE[state].encode()
            yield role, text

    def result(self, with_turns: bool) -> list:
        cost, audit = search("".join(self.initials), bytes(self.faults))
        digest, turns = hashlib.sha256(), []
        for k, (role, text) in enumerate(self.repaired(audit)):
            digest.update(b"\n" * bool(k) + role + b":" + text)
            if with_turns:
                turns.append({"role": role.decode(), "text": text.decode()})
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        self.texts.close()
        return [gaps, *(self.faults.count(k) for k in (BLANK, DUPLICATE, TRUNCATED)), self.illegal, cost, audit, digest.hexdigest(), *[turns] * with_turns]


def damage(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, copies): a row for each row, damaged by crc32 of `conv_id:turn` mod 20.

    0 drops it (copies 0), 1 empties the text, 2 takes `.`, `!` and `?` out of it, 3
    repeats it (copies 2), 4 makes the role user. Nulls are one space each, but a null
    conv_id or turn stays null in its own column.
    """
    value = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    chance = F.crc32(F.concat(value(id_col), F.lit(":"), value(turn_col)).cast("binary")) % 20
    rows = turns.select(F.col(f"`{id_col}`").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), value(role_col).alias("role"), value(text_col).alias("text"), chance.alias("chance"))
    text = F.when(F.col("chance") == 1, "").when(F.col("chance") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    copies = F.when(F.col("chance") == 0, 0).when(F.col("chance") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(F.col("chance") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copies"))


def repair(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None, with_turns: bool = False) -> DataFrame:
    """A row for each conversation: its faults, the cheapest edits and the repaired text's digest.

    conv_id, gaps, blank, duplicate, truncated, illegal, cost (long), audit and
    repaired_sha256; with_turns adds turns, the repaired (role, text). Turns are in the
    order of turn (nulls first), those of equal turn by role and text. Null roles and
    texts are one space; a null conv_id is a conversation like any other; an empty role
    has a blank as its initial. copies_col says how often a row counts; a conversation
    of which no row counts has zeros, an empty audit and the empty text's digest. No
    rows give none; other columns are not read.

    A conversation is one task's work, as its digest reads its turns in order. Its turns
    stream through; a turn leaves about 150 bytes in memory and its text in a file.
    """
    value = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    rows_in = turns.select(
        F.col(f"`{id_col}`").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), value(role_col).alias("role"),
        (F.lit(1) if copies_col is None else F.col(f"`{copies_col}`").cast("int")).alias("copies"), value(text_col).alias("text"),
    )

    def rows(batches):
        own, at = None, None
        for columns in batches:
            out = []
            for conv, turn, role, copies, text in zip(*columns):
                if own is None or conv != at:
                    if own is not None:
                        out.append([at, *own.result(with_turns)])
                    own, at = Conversation(), conv
                for _ in range(copies):
                    own.add(turn, role, text)
            if out:
                yield list(zip(*out))
        if own is not None:
            yield list(zip([at, *own.result(with_turns)]))

    kind = rows_in.schema["conv_id"].dataType.simpleString()
    ddl = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    dealt = rows_in.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return map_rows(dealt, rows, ddl + ", turns array<struct<role: string, text: string>>" * with_turns)

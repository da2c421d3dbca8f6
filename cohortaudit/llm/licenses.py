"""License scans: Aho-Corasick over words finds notice phrases and identifier tags, and a
shunting-yard parser evaluates the licence expressions that follow the tags.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator

import ahocorasick
from pyspark.sql import DataFrame

from cohortaudit.llm.common import WORD_TABLE, map_rows, project

#: Phrases whose places are counted as base.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notices: phrase, label, weight of the evidence.
NOTICES = (
    ("licensed under the apache license", "apache-2.0", 0.9),
    ("apache license version 2 0", "apache-2.0", 0.9),
    ("released under the mit license", "mit", 0.9),
    ("under the mit license", "mit", 0.8),
    ("permission is hereby granted free of charge", "mit", 0.8),
    ("redistribution and use in source and binary forms", "bsd", 0.8),
    ("mozilla public license", "mpl-2.0", 0.8),
    ("eclipse public license", "epl-2.0", 0.8),
    ("gnu lesser general public license", "lgpl", 0.9),
    ("gnu affero general public license", "agpl", 0.9),
    ("licensed under cc by nc", "cc-by-nc", 0.9),
    ("licensed under cc by sa", "cc-by-sa", 0.9),
    ("licensed under cc by nd", "cc-by-nd", 0.9),
    ("creative commons attribution", "cc-by", 0.7),
    ("dedicated to the public domain", "public-domain", 0.8),
    ("this is free and unencumbered software", "unlicense", 0.9),
)
TAGS = ("spdx license identifier", "license identifier", "license expression")
BASE_WEIGHT, TAG_WEIGHT = 0.6, 1.0
#: Licences by how much they ask of one who shares the work; others count as unknown.
RANKS = {"mit": 0, "bsd-2-clause": 0, "bsd-3-clause": 0, "isc": 0, "apache-2.0": 0, "unlicense": 0, "cc0-1.0": 0, "cc-by-4.0": 0, "mpl-2.0": 1, "epl-2.0": 1, "lgpl-2.1": 1, "lgpl-3.0": 1, "gpl-2.0": 2, "gpl-3.0": 2, "agpl-3.0": 3, "cc-by-sa-4.0": 2, "cc-by-nc-4.0": 3}
CLASSES = ("permissive", "weak-copyleft", "copyleft", "restricted", "unknown")
#: What stands between a tag's last word and its expression.
_COLON = re.compile(r"[\"']?[ \t]*[:=]", re.ASCII)
_WORD = re.compile(rb"[^ ]+")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+-]*", re.ASCII)
_STEP = re.compile(r"[\r\n]|" + _TOKEN.pattern, re.ASCII)
_POWER = {"or": 1, "and": 2, "with": 3}


def _line(text: str, at: int) -> Iterator[str]:
    """The tokens from `at` to the end of the line, found as they are asked for."""
    for m in _STEP.finditer(text, at):
        if m.group() in "\r\n":
            return
        yield m.group()


def postfix(tokens: Iterable[str]) -> list[str]:
    """Shunting-yard: `with` binds tighter than `and`, and that tighter than `or`; all from the left.

    The longest well-formed beginning is taken, and no token is asked for after the first
    that can't go on; raises ValueError where there is none.
    """
    out, held, want_name = [], [], True
    depth, sound = 0, None
    for t in tokens:
        low = t.lower()
        if low in _POWER:
            if want_name:
                break
            while held and held[-1] != "(" and _POWER[held[-1]] >= _POWER[low]:
                out.append(held.pop())
            held.append(low)
            want_name = True
        elif t == "(":
            if not want_name:
                break
            held.append(t)
            depth += 1
        elif t == ")":
            if want_name or not depth:
                break
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
            depth -= 1
        else:
            if not want_name:
                break
            out.append(low)
            want_name = False
        if not want_name and not depth:
            sound = len(out), held[::-1]  # out only grows, and outside of brackets held is short
    if sound is None:
        raise ValueError("no licence expression")
    return out[: sound[0]] + sound[1]


def evaluate(steps: list[str]) -> tuple[list[str], int]:
    """(licences, class): a choice asks what its mildest side asks, a union what its strictest.

    `with` keeps its licence under the name licence-with-exception and eases it by a class.
    """
    stack: list[tuple[deque[str], int]] = []
    for t in steps:
        if t not in _POWER:
            name = t.removesuffix("-only").removesuffix("-or-later").removesuffix("+")
            stack.append((deque([t]), RANKS.get(name, len(CLASSES) - 1)))
            continue
        (right, b), (left, a) = stack.pop(), stack.pop()
        if t == "with":
            stack.append((deque([f"{left[-1]}-with-{right[0]}"]) if len(left) == 1 else left, max(0, a - 1) if a < len(CLASSES) - 1 else a))
        else:
            if len(left) < len(right):  # the shorter side moves
                right.extendleft(reversed(left))
                left = right
            else:
                left.extend(right)
            stack.append((left, min(a, b) if t == "or" else max(a, b)))
    names, rank = stack[0]
    return sorted(set(names)), rank


class Scanner:
    """One automaton for all phrases and tags, over words held apart by single blanks."""

    def __init__(self):
        self.machine = ahocorasick.Automaton()
        told: dict[str, list] = {}
        for phrase, label in BASE.items():
            told.setdefault(phrase, []).append((True, label, BASE_WEIGHT))
        for phrase, label, weight in NOTICES:
            told.setdefault(phrase, []).append((False, label, weight))
        for phrase in TAGS:
            told.setdefault(phrase, []).append((False, None, TAG_WEIGHT))
        for phrase, what in told.items():
            self.machine.add_word(f" {phrase} ", (len(phrase) + 2, what))
        self.machine.make_automaton()

    def scan(self, text: str | None) -> list:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, expression class."""
        words = (text or "").encode().translate(WORD_TABLE).split()
        if not words:
            return [0, 0, None, None, "", "", 0.0, None]
        line = f" {b' '.join(words).decode()} "
        places, base, labels, evidence, tags = [], set(), set(), {}, set()
        word = at = 0
        for end, (size, what) in sorted(self.machine.iter(line), key=lambda m: m[0] - m[1][0]):
            start = end - size + 1
            word += line.count(" ", at, start)
            at = start
            for is_base, label, weight in what:
                if is_base:
                    places.append(word)
                    base.add(label)
                if label:
                    labels.add(label)
                    evidence[label] = max(evidence.get(label, 0.0), weight)
                else:  # the number of the tag's last word
                    tags.add(word + line.count(" ", start + 1, end))
        rank = None
        if tags:
            raw = text.encode()
            ends = [m.end() for m in _WORD.finditer(raw.translate(WORD_TABLE))]
            byte = char = 0
            for last in sorted(tags):
                char += len(raw[byte : ends[last]].decode())
                byte = ends[last]
                colon = _COLON.match(text, char)
                try:
                    names, asked = evaluate(postfix(_line(text, colon.end()) if colon else ()))
                except ValueError:
                    continue
                labels.update(names)
                evidence |= dict.fromkeys(names, TAG_WEIGHT)
                rank = asked if rank is None else max(rank, asked)
        miss = 1.0
        for weight in evidence.values():
            miss *= 1 - weight
        return [len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 - miss, None if rank is None else CLASSES[rank]]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, terms.

    n_base counts all places where a base phrase's words stand consecutively, and
    first_word and last_word are the smallest and largest of their starts. labels holds
    those of notices and of licence expressions too; score is the chance that some
    evidence holds, were the labels independent; terms is the class of what the
    expressions ask (null without one). Null and empty texts have no words, empty labels
    and score 0. Repeated rows stay, a null doc_id stays null, other columns are not read.
    """

    def rows(batches):
        scanner = Scanner()
        for ids, texts in batches:
            yield [ids, *map(list, zip(*map(scanner.scan, texts)))]

    return map_rows(project(docs, id_col, text_col), rows, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, terms string")

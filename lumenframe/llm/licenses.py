"""Licence scans: one automaton finds notice phrases and identifier tags; a shunting-yard parser reads the
expression behind each tag.

Score: how much a document's licences ask of a user, 0 (nothing found) to 1 (all rights reserved). ``or`` takes
the milder side, ``and`` the stricter one, ``with`` an exception halves the way down to permissive.

The automaton reports the words where a tag stands; its expression begins behind them and ends with the line or at the
next tag. Names are operands; one of no known family gives no label and asks ``UNKNOWN``, but behind an operator in
small letters it must look like an identifier (a digit, ``-``, ``.`` or ``+`` in it), as in "MIT and so on". An
expression that names no family and nothing that looks like an identifier is prose and says nothing.

Edge cases: null and empty texts have no words and no labels, score 0. Repeated rows are judged one by one. Extra
columns pass through; a clashing one is replaced. An empty table gives no rows.
"""

from __future__ import annotations

import re
from functools import cache

import ahocorasick
from pyspark.sql import DataFrame

from lumenframe.llm.batches import append_columns

# The phrases that make the base labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Further notices of the method.
NOTICES = {
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "apache license": "apache",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "dedicated to the public domain": "public-domain",
}
TAG = "spdx license identifier"
AFTER_TAG = re.compile(rb"[ \t]*:?[ \t]*([^\r\n]*)")
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: What a name of no known family asks.
UNKNOWN = 0.7

# Families of identifiers by prefix, longest first, and what each asks of a user.
FAMILIES = {
    "agpl": 0.9, "lgpl": 0.5, "gpl": 0.8, "apache": 0.2, "mit": 0.2, "bsd": 0.2, "isc": 0.2, "zlib": 0.2, "mpl": 0.5,
    "epl": 0.5, "cddl": 0.5, "cc-by-nc": 0.9, "cc-by-sa": 0.6, "cc-by-nd": 0.8, "cc-by": 0.3, "cc0": 0.1,
    "unlicense": 0.1, "public-domain": 0.1, "licenseref": 0.7, "proprietary": 1.0, "reserved": 1.0,
}
ORDERED = sorted(FAMILIES, key=lambda f: (-len(f), f))
RANK = {"with": 3, "and": 2, "or": 1}
PIECE = re.compile(r"[()]|[0-9A-Za-z][0-9A-Za-z.+-]*")
IDENTIFIER = re.compile(r"[0-9.+-]")
WORD_OR_SPACE = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))

SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


@cache
def family(name: str) -> str | None:
    """The family that the name is, or is a version or variant of: ``gpl``, ``gpl-2.0``, ``gplv2+``, ``bsd3``."""
    return next((f for f in ORDERED if name.startswith(f) and re.fullmatch(r"(v?\d[\d.]*)?[+]?(-.*)?", name[len(f) :])), None)


def to_postfix(text: str) -> list[str]:
    """Shunting-yard over the longest prefix of ``text`` that is a licence expression; postfix order."""
    out: list[str] = []
    stack: list[str] = []
    sound: list[str] = []
    operand, depth, before = True, 0, "OR"
    for written in PIECE.findall(text):
        piece = written.lower()
        if operand:
            if piece == "(":
                stack.append(piece)
                depth += 1
                continue
            if piece == ")" or piece in RANK or not (before.isupper() or before == "with" or family(piece) or IDENTIFIER.search(piece)):
                break
            out.append(piece)
            operand = False
        elif piece == ")":
            if not depth:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
        elif piece in RANK:
            while stack and stack[-1] != "(" and RANK[stack[-1]] >= RANK[piece]:
                out.append(stack.pop())
            stack.append(piece)
            operand, before = True, written
            continue
        else:
            break
        if not depth:
            sound = out + [s for s in reversed(stack)]
    if not sound and out:  # an unclosed bracket: its first identifier is still named
        sound = [next(p for p in out if p not in RANK)]
    return sound


def evaluate(postfix: list[str]) -> tuple[set[str], float]:
    """The families that an expression names and what it asks."""
    names = [p for p in postfix if p not in RANK]
    if not any(family(n) or IDENTIFIER.search(n) for n in names):
        return set(), 0.0
    stack: list[tuple[set[str], float]] = []
    for p in postfix:
        if p not in RANK:
            f = family(p)
            stack.append(({f} if f else set(), FAMILIES.get(f, UNKNOWN)))
            continue
        (b, y), (a, x) = stack.pop(), stack.pop()
        stack.append((a, (x + min(x, 0.2)) / 2) if p == "with" else (a | b, max(x, y) if p == "and" else min(x, y)))
    return stack[-1]


@cache
def automaton():
    a = ahocorasick.Automaton()
    for phrase, label in [*NOTICES.items(), *BASE.items(), (TAG, TAG)]:
        a.add_word(f" {phrase} ", (phrase, label))
    a.make_automaton()
    return a


def scan(text: str | None) -> tuple:
    """One document's values of SCHEMA."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.translate(WORD_OR_SPACE).split()
    joined = (b" " + b" ".join(words) + b" ").decode("utf-8", "surrogatepass")
    base: list[int] = []
    base_labels: set[str] = set()
    labels: set[str] = set()
    tags: list[int] = []
    score, at, word = 0.0, 0, 0
    for end, (phrase, label) in automaton().iter(joined):
        start = end - len(phrase) - 1  # of the space before the phrase
        if phrase != TAG:
            labels.add(label)
            score = max(score, FAMILIES[label])
        if phrase == TAG or phrase in BASE:
            if start >= at:
                word, at = word + joined.count(" ", at, start), start
                place = word
            else:  # a longer phrase was reported first
                place = word - joined.count(" ", start, at)
            if phrase == TAG:
                tags.append(place)
            else:
                base.append(place)
                base_labels.add(label)
    if tags:
        spans = [m.span() for m in WORD.finditer(raw)]
        # an expression ends with its line, or where the next tag begins
        for t, stop in zip(tags, [spans[n][0] for n in tags[1:]] + [len(raw)], strict=True):
            said = AFTER_TAG.match(raw, spans[t + TAG.count(" ")][1], stop)[1]
            named, asks = evaluate(to_postfix(said.decode("utf-8", "replace")))
            labels |= named
            score = max(score, asks)
    return len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score


def license_scan(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with SCHEMA's columns."""
    return append_columns(df, lambda texts: map(scan, texts), text, SCHEMA)

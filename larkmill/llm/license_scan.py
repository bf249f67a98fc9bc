"""License scans: notice phrases and identifier tags by Aho-Corasick, licence expressions by a shunting yard.

One automaton runs over a text's words, parted by single spaces, and finds phrases wherever their words stand
consecutively, overlapping or not. Another runs over the text as it stands and finds tags such as
``SPDX-License-Identifier:``; what follows a tag is parsed as a licence expression (``with`` binds before ``and``,
``and`` before ``or``, brackets before all) and valued: the terms of ``and`` all bind, so the least permission counts;
``or`` leaves the choice, so the greatest does; an exception of ``with`` lifts a copyleft licence to a weak one.

A phrase within a longer one is part of another licence's name: only base phrases are reported then, without a say in
the score. A text's score is the permission its notices leave together, 1 for permissive ones, and 0 without any notice, since
nothing is permitted then. Terms of no known licence permit nothing.

Defined cases: a null text counts as empty; only A-Z are lowered, and words are of ASCII letters and digits and all
characters beyond ASCII; whole texts are read, of any length; an expression ends where it can't go on, and one that
can't be read says nothing but is counted in n_unread; a plain ``license:`` field counts only if all of its terms are
known licences, as other things stand behind such words; brackets may be nested to any depth; repeated rows each get a
row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkmill.llm.batches import bound_batches

# The base phrases and their labels, as the contract states them.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# What a family of licences permits: 1 permissive, 0.5 weak copyleft, 0.25 copyleft, 0.1 copyleft over networks or no
# changes or no trade, 0 nothing.
FAMILIES = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "zlib": 1.0, "bsl": 1.0, "unlicense": 1.0, "cc0": 1.0, "0bsd": 1.0,
    "cc-by": 1.0, "psf": 1.0, "wtfpl": 1.0, "lgpl": 0.5, "mpl": 0.5, "epl": 0.5, "cddl": 0.5, "artistic": 0.5, "cc-by-sa": 0.25,
    "gpl": 0.25, "gfdl": 0.25, "eupl": 0.25, "agpl": 0.1, "cc-by-nc": 0.1, "cc-by-nd": 0.1, "cc-by-nc-sa": 0.1,
    "cc-by-nc-nd": 0.1, "reserved": 0.0,
}
WEAK = 0.5
MORE_PHRASES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd", "bsd license": "bsd", "isc license": "isc",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "lesser general public license": "lgpl", "library general public license": "lgpl", "affero general public license": "agpl",
    "mozilla public license": "mpl", "eclipse public license": "epl", "boost software license": "bsl", "zlib license": "zlib",
    "common development and distribution license": "cddl", "artistic license": "artistic",
    "european union public licence": "eupl", "free documentation license": "gfdl", "python software foundation license": "psf",
    "free and unencumbered software released into the public domain": "unlicense",
    "creative commons attribution": "cc-by", "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc", "creative commons attribution noderivs": "cc-by-nd",
    "creative commons zero": "cc0", "all rights reserved": "reserved",
}
# Tags behind which an expression stands, and whether it may name licences that aren't known.
TAGS = {
    "spdx-license-identifier:": True, "license-expression:": True, "license:": False, '"license":': False, "licence:": False,
    '"licence":': False, "license =": False,
}

LOWER = bytes(b | 32 if 65 <= b <= 90 else b for b in range(256))
APART = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in LOWER)  # lowered, all that is in no word a space
# No term holds what ends a tag, so an expression never runs on into the next tag's.
TERM = re.compile(r"[ \t]*([()]|[a-z0-9](?:[a-z0-9.+-]*[a-z0-9+])?)")
BINDS = {"or": 1, "and": 2, "with": 3}
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double,"
    " expressions string, n_unread long, spans string"
)


def family(term: str) -> str | None:
    """The known family that a licence identifier is of: the longest that it begins with, in whole parts."""
    name = term.rstrip("+")
    while name not in FAMILIES:
        name, dash, _ = name.rpartition("-")
        if not dash:
            return None
    return name


@dataclass(frozen=True)
class Expression:
    """``text`` in a canonical form, its ``terms``, what it permits, and where its last term ends."""

    text: str
    terms: tuple[str, ...]
    permits: float
    end: int


def parse_expression(text: str, start: int = 0) -> Expression | None:
    """The expression that begins at ``start`` of a lowered text, as far as it goes; None if none can be read."""
    values: list[tuple[str, float, int]] = []  # text, permission, and the binding of its outermost operator
    held: list[str] = []
    terms: list[str] = []
    end, wants_term, open_brackets = start, True, 0

    def combine() -> None:
        operator = held.pop()
        (right, b, rb), (left, a, lb) = values.pop(), values.pop()
        bind = BINDS[operator]
        both = {"or": max(a, b), "and": min(a, b), "with": max(a, WEAK) if 0 < a else a}[operator]
        said = [f"({x})" if own < bind else x for x, own in ((left, lb), (right, rb))]
        values.append((f"{said[0]} {operator} {said[1]}", both, bind))

    at = start
    while m := TERM.match(text, at):
        term = m[1]
        if wants_term:
            if term == "(":
                held.append(term)
                open_brackets += 1
            elif term == ")" or term in BINDS:
                return None
            else:
                exception = bool(held) and held[-1] == "with"
                if not exception:
                    terms.append(term)
                values.append((term, 1.0 if exception else FAMILIES.get(family(term) or "", 0.0), 4))
                wants_term = False
        elif term == ")" and open_brackets:
            while held[-1] != "(":
                combine()
            held.pop()
            open_brackets -= 1
        elif term in BINDS and TERM.match(text, m.end()):
            if term == "with" and (values[-1][2] < 4 or held[-1:] == ["with"]):
                return None  # one exception belongs to one licence
            while held and held[-1] != "(" and BINDS[held[-1]] >= BINDS[term]:
                combine()
            held.append(term)
            wants_term = True
        else:
            break
        at = m.end()
        end = at
    if wants_term or open_brackets:
        return None
    while held:
        combine()
    return Expression(values[0][0], tuple(terms), values[0][1], end)


@dataclass(frozen=True)
class Notice:
    kind: str  # base, phrase or tag
    label: str
    start: int  # words for phrases, code points for tags
    end: int
    permits: float | None  # None for a base phrase within a longer one


@dataclass(frozen=True)
class Scan:
    n_words: int
    notices: list[Notice]
    expressions: list[str]
    n_unread: int


class Scanner:
    """Both automata; made once per process."""

    def __init__(self, base: dict[str, str] = BASE_PHRASES, more: dict[str, str] = MORE_PHRASES, tags: dict[str, bool] = TAGS):
        self.phrases = ahocorasick.Automaton()
        for kind, phrases in (("phrase", more), ("base", base)):
            for phrase, label in phrases.items():
                self.phrases.add_word(f" {phrase} ", (kind, label, len(phrase) + 2, phrase.count(" ") + 1))
        self.phrases.make_automaton()
        self.tags = ahocorasick.Automaton()
        for tag, any_term in tags.items():
            self.tags.add_word(tag, (any_term, len(tag)))
        self.tags.make_automaton()

    def scan(self, text: str | None) -> Scan:
        data = (text or "").encode("utf-8", "surrogatepass")
        words = data.translate(APART).split()
        plain = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
        # By the start of the first word, longest first: what lies within a longer phrase is part of another name.
        hits = sorted((last - hit[2] + 2, -hit[3], hit) for last, hit in self.phrases.iter(plain))
        notices, seen, at, covered = [], 0, 1, 0
        for start, _, (kind, label, _, size) in hits:
            seen += plain.count(" ", at, start)
            at = start
            inside = seen + size <= covered
            covered = max(covered, seen + size)
            if kind == "base" or not inside:
                notices.append(Notice(kind, label, seen, seen + size, None if inside else FAMILIES[label]))
        expressions, unread = [], 0
        for label, expression, start in self.tagged(data):
            if expression is None:
                unread += label
                continue
            expressions.append(expression.text)
            for term in expression.terms:
                notices.append(Notice("tag", family(term) or term, start, expression.end, expression.permits))
        return Scan(len(words), notices, expressions, unread)

    def tagged(self, data: bytes) -> Iterator[tuple[bool, Expression | None, int]]:
        """(whether any term goes, the expression, where its tag starts) for each tag that counts."""
        text = data.translate(LOWER).decode("utf-8", "surrogatepass")
        done = 0
        for last, (any_term, width) in self.tags.iter(text):
            if last < done:
                continue  # within an expression, or the end of a longer tag
            start = last + 1
            while text[start : start + 1] in (" ", "\t", '"', "'") and start < len(text):
                start += 1
            expression = parse_expression(text, start)
            if not any_term and (expression is None or not all(map(family, expression.terms))):
                continue
            done = expression.end if expression else start
            yield any_term, expression, last - width + 1


_BUILT: list[Scanner] = []


def scanner() -> Scanner:
    if not _BUILT:
        _BUILT.append(Scanner())
    return _BUILT[0]


def row_of(found: Scan) -> tuple:
    base = [n for n in found.notices if n.kind == "base"]
    of = lambda notices: ",".join(sorted({n.label for n in notices}))
    return (
        found.n_words, len(base), base[0].start if base else None, base[-1].start if base else None, of(base), of(found.notices),
        min((n.permits for n in found.notices if n.permits is not None), default=0.0), "; ".join(found.expressions), found.n_unread,
        ",".join(f"{n.kind}:{n.label}:{n.start}:{n.end}" for n in found.notices),
    )


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the words, the base places, all labels, the score, the expressions of its tags and all
    spans (in words for phrases, in code points for tags)."""
    bound_batches(docs.sparkSession)
    fields = [c.split() for c in SCHEMA.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row_of(scanner().scan(body.as_py())) for body in batch.column("text")]
            made = list(zip(*rows, strict=True)) if rows else [()] * (len(fields) - 1)
            columns = [pa.array(list(x), kinds[kind]) for x, (_, kind) in zip(made, fields[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], [name for name, _ in fields])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)

"""A combined deterministic automaton for search rules over bytes.

Rules are written in a small regex dialect (literals, ``\\xHH``, classes, groups, ``|``, ``? * + {m} {m,}``). Each rule
becomes an NFA; subset construction over threads ordered by their start gives a DFA that finds leftmost,
non-overlapping, longest matches; the product of the rules' DFAs is minimised by partition refinement and laid out as
one transition array, so that one pass over the bytes runs every rule.

A rule must go on matching, once it has matched, until its thread dies (it ends in a repeated class); others raise
ValueError when compiled. The end of a match is then the byte where its thread dies.
"""

from __future__ import annotations

from dataclasses import dataclass

END = 256  # the pseudo-byte after the last one


class _Parser:
    """Builds an NFA as lists of byte edges and empty edges."""

    def __init__(self, pattern: str, fold: bool):
        self.p, self.i, self.fold = pattern, 0, fold
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def node(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def take(self) -> str:
        self.i += 1
        return self.p[self.i - 1]

    def char(self) -> int:
        c = self.take()
        if c != "\\":
            return ord(c)
        c = self.take()
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return ord(c)

    def cased(self, found: set[int]) -> frozenset[int]:
        if self.fold:
            found |= {b ^ 32 for b in found if chr(b).isascii() and chr(b).isalpha()}
        return frozenset(found)

    def klass(self) -> frozenset[int]:
        found: set[int] = set()
        while self.peek() != "]":
            low = self.char()
            high = low
            if self.peek() == "-" and self.p[self.i + 1] != "]":
                self.take()
                high = self.char()
            found |= set(range(low, high + 1))
        self.take()
        return self.cased(found)

    def choice(self) -> tuple[int, int]:
        a, b = self.node(), self.node()
        while True:
            x, y = self.row()
            self.empty[a].append(x)
            self.empty[y].append(b)
            if self.peek() != "|":
                return a, b
            self.take()

    def row(self) -> tuple[int, int]:
        a = b = self.node()
        while self.peek() not in ("", "|", ")"):
            x, y = self.repeated()
            self.empty[b].append(x)
            b = y
        return a, b

    def repeated(self) -> tuple[int, int]:
        begin = self.i
        x, y = self.atom()
        after = self.peek()
        if after == "" or after not in "?*+{":
            return x, y
        stop = self.i
        self.take()
        low, high = {"?": (0, 1), "*": (0, None), "+": (1, None), "{": (0, 0)}[after]
        if after == "{":
            until = self.p.index("}", self.i)
            said = self.p[self.i : until]
            self.i = until + 1
            low = int(said.split(",")[0])
            high = None if said.endswith(",") else int(said.split(",")[-1])
        resume = self.i

        def again() -> tuple[int, int]:
            self.i = begin
            out = self.atom()
            assert self.i == stop
            self.i = resume
            return out

        a = b = self.node()
        for k in range(low):
            x, y = (x, y) if k == 0 else again()
            self.empty[b].append(x)
            b = y
        if high is None:
            x, y = again() if low else (x, y)
            end = self.node()
            self.empty[b] += [x, end]
            self.empty[y] += [x, end]
            return a, end
        end = self.node()
        self.empty[b].append(end)
        for k in range(low, high):
            x, y = (x, y) if k == 0 else again()
            self.empty[b].append(x)
            self.empty[y].append(end)
            b = y
        return a, end

    def atom(self) -> tuple[int, int]:
        if self.peek() == "(":
            self.take()
            out = self.choice()
            self.take()
            return out
        if self.peek() == "[":
            self.take()
            found = self.klass()
        else:
            found = self.cased({self.char()})
        a, b = self.node(), self.node()
        self.edges[a].append((found, b))
        return a, b


class _Search:
    """The leftmost search DFA of one rule, made state by state on demand."""

    def __init__(self, pattern: str, fold: bool):
        parser = _Parser(pattern, fold)
        start, self.final = parser.choice()
        if parser.i != len(pattern):
            raise ValueError(f"unread rest of rule: {pattern[parser.i :]}")
        self.parser = parser
        self.start = self.closed({start})

    def closed(self, nodes) -> frozenset[int]:
        todo, seen = list(nodes), set(nodes)
        while todo:
            for x in self.parser.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(x for x in seen if x == self.final or self.parser.edges[x])

    def moved(self, nodes: frozenset[int], byte: int) -> frozenset[int]:
        return self.closed({to for x in nodes for on, to in self.parser.edges[x] if byte in on})

    def next(self, state: tuple[frozenset[int], ...], byte: int) -> tuple[tuple[frozenset[int], ...], bool]:
        """The state after ``byte`` and whether a match ended just before it. A state lists threads, earliest first."""
        if state and self.final in state[0]:
            if byte != END and (kept := self.moved(state[0], byte)):
                if self.final not in kept:
                    raise ValueError("a rule must go on matching until its thread dies")
                return (kept,), False
            return (() if byte == END else self.next((), byte)[0]), True
        if byte == END:
            return (), False
        out: list[frozenset[int]] = []
        seen: set[int] = set()
        for thread in (*state, self.start):
            fresh = self.moved(thread, byte) - seen
            if fresh:
                if self.final in fresh and out:
                    raise ValueError("a later start matches before an earlier one is settled")
                out.append(fresh)
                seen |= fresh
                if self.final in fresh:
                    break
        return tuple(out), False


@dataclass(frozen=True)
class Automaton:
    """``table[state + byte]`` is the next state, plus ``big * mask`` if the matches in ``mask`` ended before that byte.

    States are multiples of 257; a mask has a bit for each rule.
    """

    names: tuple[str, ...]
    table: list[int]
    big: int
    states: int

    def ends(self, data: bytes) -> list[tuple[int, int]]:
        """(end, mask) wherever matches end."""
        table, big, state, found = self.table, self.big, 0, []
        for i, byte in enumerate(data):
            state = table[state + byte]
            if state >= big:
                mask, state = divmod(state, big)
                found.append((i, mask))
        state = table[state + END]
        if state >= big:
            found.append((len(data), state // big))
        return found


def compile_rules(rules: list[tuple[str, str, bool]]) -> Automaton:
    """The minimal combined automaton of (name, pattern, either case) rules."""
    parts = [_Search(pattern, fold) for _, pattern, fold in rules]
    splits = {frozenset(on) for part in parts for edges in part.parser.edges for on, _ in edges}
    classes: dict[tuple[bool, ...], int] = {}
    of = [0] * 257
    samples: list[int] = []
    for byte in range(256):
        mark = tuple(byte in on for on in splits)
        if mark not in classes:
            classes[mark] = len(samples)
            samples.append(byte)
        of[byte] = classes[mark]
    of[END] = len(samples)
    samples.append(END)

    start = tuple(() for _ in parts)
    index, rows, order = {start: 0}, [], [start]
    for state in order:
        row = []
        for byte in samples:
            moved = [part.next(own, byte) for part, own in zip(parts, state, strict=True)]
            after = tuple(m[0] for m in moved)
            mask = sum(1 << k for k, m in enumerate(moved) if m[1])
            if after not in index:
                index[after] = len(order)
                order.append(after)
            row.append((index[after], mask))
        rows.append(row)

    block = [0] * len(rows)
    count = 1
    while True:
        marks = [tuple((block[to], mask) for to, mask in row) for row in rows]
        names: dict[tuple, int] = {}
        block = [names.setdefault((own, mark), len(names)) for own, mark in zip(block, marks, strict=True)]
        if len(names) == count:
            break
        count = len(names)
    # The start state is seen first, so its block is 0.
    width = 257
    big = width * count
    table = [0] * big
    for own, row in zip(block, rows, strict=True):
        for byte in range(width):
            to, mask = row[of[byte]]
            table[own * width + byte] = block[to] * width + big * mask
    return Automaton(tuple(name for name, _, _ in rules), table, big, count)

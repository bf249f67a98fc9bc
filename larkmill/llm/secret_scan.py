"""Secret scans: all rules in one byte pass of a combined automaton, then an exact check of each hit.

The automaton gives where matches end; the rule's own expression, run over the few bytes before that end, gives the
start and checks lengths. Spans are in code points, the end exclusive.

Defined cases: a null text counts as empty and has no spans; repeated rows each get a row; texts of any length are
scanned whole; input columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkmill.llm.batches import bound_batches
from larkmill.llm.automaton import Automaton, compile_rules


@dataclass(frozen=True)
class SecretRule:
    name: str
    pattern: str
    fold: bool = False  # letters in either case
    group: int = 0
    least: int = 1  # characters of the group, or else the match is dropped


# The base kinds as the contract states them. The automaton itself counts the length of hex runs,
# which shorter runs would otherwise flood.
BASE_RULES = (
    SecretRule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6),
    SecretRule("access", r"AKIA[A-Z0-9]+", False, 0, 20),
    SecretRule("hex", r"[0-9a-f]{24,}", False, 0, 24),
)
# Published token formats beyond the base kinds.
MORE_RULES = (
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]+", False, 0, 40),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]+", False, 0, 20),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_.-]+", False, 0, 30),
    SecretRule("google", r"AIza[A-Za-z0-9_-]+", False, 0, 39),
)
ALL_RULES = BASE_RULES + MORE_RULES
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
_BUILT: dict[tuple[SecretRule, ...], Automaton] = {}


def automaton(rules: tuple[SecretRule, ...] = ALL_RULES) -> Automaton:
    """Built once per process."""
    if rules not in _BUILT:
        _BUILT[rules] = compile_rules([(r.name, r.pattern, r.fold) for r in rules])
    return _BUILT[rules]


def find_spans(
    text: str | None, rules: tuple[SecretRule, ...] = ALL_RULES, built: Automaton | None = None
) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then in the rules' order."""
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    ends = (built or automaton(rules)).ends(data)
    if not ends:
        return []
    checks = [re.compile(r.pattern.encode(), re.IGNORECASE if r.fold else 0) for r in rules]
    last = [0] * len(rules)
    spans = []
    for end, mask in ends:
        for k, rule in enumerate(rules):
            if not mask >> k & 1:
                continue
            # The automaton has settled that a match ends here and none of this rule ended since last[k].
            hit = next((m for m in checks[k].finditer(data, _floor(data, rule, last[k], end), end) if m.end() == end))
            last[k] = end
            if hit.end(rule.group) - hit.start(rule.group) >= rule.least:
                spans.append((hit.start(), k, end))
    spans.sort()
    place = _places(data, sorted({p for s, _, e in spans for p in (s, e)}))
    return [(rules[k].name, place[s], place[e]) for s, k, e in spans]


def _floor(data: bytes, rule: SecretRule, last: int, end: int) -> int:
    """A start for the exact check: matches hold no byte beyond ASCII and no line break."""
    at = max(last, end - 512)
    while at > last and 9 != data[at - 1] != 10 and data[at - 1] < 128:
        at = max(last, at - 512)
    return at


def _places(data: bytes, offsets: list[int]) -> dict[int, int]:
    """Code points before each byte offset."""
    out, seen, at = {}, 0, 0
    for x in offsets:
        seen += len(data[at:x].decode("utf-8", "surrogatepass"))
        out[x], at = seen, x
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans, and all spans.

    The automaton is built on the driver and broadcast; its size depends on the rules alone (about a million entries).
    """
    built = docs.sparkSession.sparkContext.broadcast(automaton())
    bound_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = [r.name for r in BASE_RULES]
        for batch in batches:
            rows = []
            for body in batch.column("text"):
                spans = find_spans(body.as_py(), ALL_RULES, built.value)
                own = [s for s in spans if s[0] in base]
                digest = hashlib.sha256(joined(own).encode()).hexdigest()
                rows.append((*(sum(s[0] == kind for s in own) for kind in base), digest, joined(spans)))
            made = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            columns = [pa.array(list(x), kind) for x, kind in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], [c.split()[0] for c in SCHEMA.split(", ")])

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(scan, SCHEMA)

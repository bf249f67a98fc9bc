"""Fill-in-middle: texts cut in three and put together with their middle last, by bit-parallel work on big integers.

The bytes of a text become class masks, integers with a bit for each byte: ``bytes.translate`` marks the class, a base-2
reading makes the integer. Shifted boolean operations mark the byte at which each unit ends, ``bit_count`` gives the
number of units, and the byte at which the k-th unit ends is found by halving the integer, which takes time in
proportion to the text, as the halves shrink.

Units are code points, words (each with the white space after it; white space before the first word is a unit) or
lines (each with its line feed). Where to cut, and whether, are drawn from a SHA-256 of the id, so reruns agree and no
row depends on another.

Defined cases: a null text is empty, and stays plain; so does one that holds a sentinel; a null id is written as
nothing where the id is hashed; repeated rows each get a row; whole texts are cut, of any length; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkmill.llm.batches import bound_batches

SCHEMA = "doc_id long, n long, form string, prefix_units long, middle_units long, output string"
SMALL = 512  # bits below which a chosen bit is counted out


@dataclass(frozen=True)
class Sentinels:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        starts = {m[0] for m in self}
        if len(set(self)) < 3 or any(c in starts for m in self for c in m[1:]):
            raise ValueError("a sentinel must not hold, after its first character, one that begins a sentinel")

    def __iter__(self) -> Iterator[str]:
        return iter((self.prefix, self.suffix, self.middle))


@dataclass(frozen=True)
class Rates:
    plain_from: int = 90  # of 100 draws, those from here on stay plain
    spm_below: int = 20  # of 100 draws, those below put the suffix first


def _class_table(members: bytes) -> bytes:
    return bytes(49 if b in members else 48 for b in range(256))


# A continuation byte of UTF-8 is 10xxxxxx; white space is that of the ASCII range.
CONTINUES = _class_table(bytes(range(0x80, 0xC0)))
SPACE = _class_table(b" \t\n\v\f\r")
FEED = _class_table(b"\n")


def class_mask(data: bytes, table: bytes) -> int:
    """Bit i is set if byte i is in the class."""
    return int(data.translate(table)[::-1], 2) if data else 0


def unit_ends(data: bytes, units: str = "code_points") -> int:
    """Bit i is set if a unit ends with byte i. The last byte always ends one."""
    if not data:
        return 0
    last = 1 << (len(data) - 1)
    if units == "code_points":
        return ~(class_mask(data, CONTINUES) >> 1) & (last - 1) | last
    if units == "words":
        space = class_mask(data, SPACE)
        return space & ~(space >> 1) & (last - 1) | last
    if units == "lines":
        return class_mask(data, FEED) | last
    raise ValueError(f"no such units: {units}")


def select_bit(mask: int, k: int) -> int:
    """The place of the ``k``-th set bit, counted from 0."""
    place, width = 0, mask.bit_length()
    while width > SMALL:
        half = width >> 1
        low = mask & ((1 << half) - 1)
        below = low.bit_count()
        if k < below:
            mask, width = low, half
        else:
            mask, k, place, width = mask >> half, k - below, place + half, width - half
    for _ in range(k):
        mask &= mask - 1
    return place + (mask & -mask).bit_length() - 1


def draws(doc_id: int | None, seed: str = "1") -> list[int]:
    """Four numbers of 32 bits, drawn for an id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


@dataclass(frozen=True)
class Cut:
    n: int
    form: str
    output: str
    prefix_units: int | None = None
    middle_units: int | None = None


def fill_middle(
    text: str | None, doc_id: int | None, units: str = "code_points", rates: Rates = Rates(), marks: Sentinels = Sentinels(), seed: str = "1"
) -> Cut:
    data = (text or "").encode("utf-8", "surrogatepass")
    ends = unit_ends(data, units)
    n = ends.bit_count()
    h = draws(doc_id, seed)
    if not text or any(m in text for m in marks) or h[2] % 100 >= rates.plain_from:
        return Cut(n, "plain", text or "")
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    at, to = (select_bit(ends, k - 1) + 1 if k else 0 for k in (a, b))
    prefix, middle, suffix = (x.decode("utf-8", "surrogatepass") for x in (data[:at], data[at:to], data[to:]))
    if h[3] % 100 < rates.spm_below:
        return Cut(n, "spm", f"{marks.suffix}{suffix}{marks.prefix}{prefix}{marks.middle}{middle}", a, b - a)
    return Cut(n, "psm", f"{marks.prefix}{prefix}{marks.suffix}{suffix}{marks.middle}{middle}", a, b - a)


def restored(output: Column, form: Column, marks: Sentinels = Sentinels()) -> Column:
    """The text an output was made from: no sentinel arises where a piece of a text meets one, as none holds the first
    character of another further on, so the pieces lie between the three."""
    parts = F.split(output, "|".join(map(re.escape, marks)), -1)
    return (
        F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(output)
    )


def fill_middle_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    units: str = "code_points",
    rates: Rates = Rates(),
    marks: Sentinels = Sentinels(),
    seed: str = "1",
) -> DataFrame:
    """(doc_id, n, form, prefix_units, middle_units, output) of each row."""
    bound_batches(docs.sparkSession)
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            cuts = [fill_middle(body.as_py(), i, units, rates, marks, seed) for body, i in zip(batch.column("text"), ids, strict=True)]
            numbers = [pa.array([getattr(c, name) for c in cuts], pa.int64()) for name in ("n", "prefix_units", "middle_units")]
            said = [pa.array([getattr(c, name) for c in cuts], pa.string()) for name in ("form", "output")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), numbers[0], said[0], *numbers[1:], said[1]], names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)

"""Ranks and headlines from the places of a query's terms in a document.

``entries`` are structs (pos, slot) in order of pos: where in the text a term stands, and which term it is. Constants are
those of the ranks in use: every term weighs 0.1.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEIGHT = 0.1
PI_SQUARED_SIXTH = 1.64493406685
REACH = 100  # places beyond which two terms don't lift a rank

COVER = "struct<first:int,last:int,inside:int>"


def covers(entries: Column, n_terms: Column) -> Column:
    """The minimal stretches that hold all terms, in order: first and last place, and how many entries lie inside.

    From one entry to the next the latest place of each term is carried; the earliest of these begins the shortest
    stretch that ends here. It is minimal if it begins later than the one before.
    """
    seat = "struct<at:int,idx:int>"
    start = F.struct(
        F.transform(F.sequence(F.lit(1), F.greatest(n_terms.cast("int"), F.lit(1))), lambda _: F.lit(None).cast(seat)).alias("latest"),
        F.array().cast(f"array<{COVER}>").alias("found"),
    )

    def step(acc: Column, e: Column) -> Column:
        entry, idx = e["entry"], e["idx"]
        latest = F.transform(
            acc["latest"],
            lambda held, slot: F.when(slot == entry["slot"], F.struct(entry["pos"].alias("at"), idx.alias("idx")).cast(seat)).otherwise(held),
        )
        return F.struct(latest.alias("latest"), acc["found"].alias("found"))

    def closed(acc: Column, e: Column) -> Column:
        first = F.array_min(acc["latest"])
        whole = ~F.exists(acc["latest"], lambda x: x.isNull())
        later = F.coalesce(first["at"] > F.try_element_at(acc["found"], F.lit(-1))["first"], F.lit(True))
        cover = F.struct(first["at"].alias("first"), e["entry"]["pos"].alias("last"), (e["idx"] - first["idx"] + 1).alias("inside")).cast(COVER)
        return F.struct(acc["latest"].alias("latest"), F.when(whole & later, F.concat(acc["found"], F.array(cover))).otherwise(acc["found"]).alias("found"))

    numbered = F.transform(entries, lambda x, i: F.struct(F.struct(x["pos"].cast("int").alias("pos"), x["slot"].cast("int").alias("slot")).alias("entry"), i.alias("idx")))
    return F.aggregate(numbered, start, lambda acc, e: closed(step(acc, e), e), lambda acc: acc["found"])


def cover_density(found: Column) -> Column:
    """The sum over covers of 0.1 / (1 + places inside that hold no term), brought below 1 by r / (r + 1)."""
    noise = lambda c: F.greatest(c["last"] - c["first"] + 1 - c["inside"], F.lit(0))
    total = F.aggregate(found, F.lit(0.0), lambda acc, c: acc + WEIGHT / (1 + noise(c)))
    return total / (total + 1)


def frequency_rank(entries: Column, n_terms: Column) -> Column:
    """The mean over terms of 0.1 times the sum of 1 / j^2 over a term's places, brought to 0.1 at most."""
    slots = F.transform(entries, lambda e: e["slot"].cast("int"))
    mass = F.aggregate(
        F.sequence(F.lit(0), n_terms.cast("int") - 1),
        F.lit(0.0),
        lambda acc, s: acc
        + F.aggregate(
            F.filter(slots, lambda x: x == s),
            F.struct(F.lit(0.0).alias("sum"), F.lit(1).alias("j")),
            lambda a, _: F.struct((a["sum"] + 1 / (a["j"].cast("double") * a["j"])).alias("sum"), (a["j"] + 1).alias("j")),
            lambda a: a["sum"],
        ),
    )
    return WEIGHT * mass / PI_SQUARED_SIXTH / n_terms


def proximity_rank(entries: Column, n_terms: Column) -> Column:
    """How near to each other different terms stand: 1 - the product of (1 - w) over all pairs of places of different
    terms, where w falls with their distance. With a single term, ``frequency_rank``."""
    near = lambda d: WEIGHT * F.sqrt(1 / (1.005 + 0.05 * F.exp(d / 1.5 - 2)))
    kind = "array<struct<pos:int,slot:int>>"
    start = F.struct(F.lit(1.0).alias("left"), F.array().cast(kind).alias("recent"))

    def step(acc: Column, e: Column) -> Column:
        recent = F.filter(acc["recent"], lambda x: e["pos"] - x["pos"] <= REACH)
        left = F.aggregate(
            recent, acc["left"], lambda a, x: F.when(x["slot"] == e["slot"], a).otherwise(a * (1 - near((e["pos"] - x["pos"]).cast("double"))))
        )
        return F.struct(left.alias("left"), F.concat(recent, F.array(e)).alias("recent"))

    whole = F.transform(entries, lambda e: F.struct(e["pos"].cast("int").alias("pos"), e["slot"].cast("int").alias("slot")).cast("struct<pos:int,slot:int>"))
    pairs = F.aggregate(whole, start, step, lambda acc: 1 - acc["left"])
    return F.when(n_terms < 2, frequency_rank(entries, n_terms)).otherwise(pairs)


def headline(words: Column, entries: Column, found: Column, most: int = 35, begin: str = "<b>", end: str = "</b>") -> Column:
    """Up to ``most`` of a text's ``words`` round its shortest cover (the first of equal ones), terms marked. A cover
    longer than that is shown from its start; without a cover, the text is shown from its first entry."""
    shortest = F.array_min(F.transform(found, lambda c: F.struct((c["last"] - c["first"] + 1).alias("size"), c["first"].alias("first"))))
    size = F.coalesce(shortest["size"], F.lit(1))
    spare = F.greatest(F.lit(most) - size, F.lit(0))
    first = F.greatest(F.coalesce(shortest["first"], F.get(entries, 0)["pos"], F.lit(1)) - F.floor(spare / 2), F.lit(1)).cast("int")
    places = F.transform(entries, lambda e: e["pos"].cast("int"))
    shown = F.transform(
        F.slice(words, first, most),
        lambda w, i: F.when(F.array_contains(places, i + first), F.concat(F.lit(begin), w, F.lit(end))).otherwise(w),
    )
    return F.array_join(shown, " ")

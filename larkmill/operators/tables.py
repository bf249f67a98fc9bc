"""Table operators: filters by parameter, soft deletes, upserts, range and as-of joins, lineage, numbering."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkmill.session import cut_lineage


def optional_filters(df: DataFrame, equal: dict, at_least: dict | None = None) -> DataFrame:
    """Conjunction of the filters whose parameter isn't None."""
    for name, value in equal.items():
        df = df if value is None else df.where(F.col(name) == value)
    for name, value in (at_least or {}).items():
        df = df if value is None else df.where(F.col(name) >= value)
    return df


def within(df: DataFrame, ts: str, ref: str, days: int) -> DataFrame:
    end = F.lit(ref).cast("timestamp_ntz")
    return df.where((F.col(ts) >= end - F.expr(f"INTERVAL {days} DAYS")) & (F.col(ts) < end))


def soft_delete(df: DataFrame, which: Column, ref: str) -> DataFrame:
    return df.withColumn("deleted_at", F.when(which, F.lit(ref).cast("timestamp_ntz")))


def restore(df: DataFrame, which: Column) -> DataFrame:
    return df.withColumn("deleted_at", F.when(~which, F.col("deleted_at")))


def upsert(
    stored: DataFrame, incoming: DataFrame, key: str, fingerprint: str, columns: list[str]
) -> DataFrame:
    """Stored rows after taking in new ones: status created, updated (other fingerprint), duplicate or kept.

    The last incoming row of a key wins by fingerprint order; change_count grows with each update.
    """
    newest = incoming.groupBy(key).agg(F.max(F.struct(fingerprint, *columns)).alias("new"))
    old = stored.select(key, F.struct(fingerprint, *columns).alias("old"), F.col("change_count").alias("old_count"))
    both = old.join(newest, key, "full")
    changed = F.col(f"old.{fingerprint}") != F.col(f"new.{fingerprint}")
    status = (
        F.when(F.col("new").isNull(), "kept")
        .when(F.col("old").isNull(), "created")
        .when(changed, "updated")
        .otherwise("duplicate")
    )
    pick = lambda c: F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))
    return both.select(
        key, *[pick(c).alias(c) for c in [fingerprint, *columns]], status.alias("status"),
        (F.coalesce("old_count", F.lit(0)) + (status == "updated").cast("int")).cast("long").alias("change_count"),
    )


def update_by_id(df: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Bulk UPDATE ... FROM: columns take the value of the change with the same key, if there is one."""
    new = changes.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = df.join(new, key, "left")
    picked = {c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(picked).select(*df.columns)


def delete_by_key(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_anti")


def range_pairs(df: DataFrame, group: str, row_id: str, value: str, tolerance: float, task_pairs: int = 16 << 20) -> DataFrame:
    """Pairs of rows of a group whose values differ by at most the tolerance, itself excluded.

    Values are cut into bands a little wider than the tolerance, as gaps are rounded and a quotient may fall short of a
    whole number; a row meets its own band and both neighbours by equality. The pairs may be many more than the rows, so
    tasks are made by counts of the pairs to be met, about ``task_pairs`` each, and a band with more is met in squares.
    """
    band = F.floor(F.col(value) / (tolerance * 1.001 + 1e-6))
    near = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    rows = cut_lineage(df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(row_id).alias("id"), F.col(value).alias("v"), band.alias("own")))
    met = rows.groupBy("g", "own").agg(F.count("*").alias("n")).select("g", "own", "n", near.alias("near")).withColumn("band", F.col("own") + F.col("near"))
    met = met.groupBy("g", "band").agg(F.sum("n").alias("l"), F.sum(F.when(F.col("own") == F.col("band"), F.col("n"))).alias("r")).where("r > 0")
    pairs = F.col("l") * F.col("r").cast("double")
    cells = cut_lineage(met.select("g", "band", pairs.alias("pairs"), F.ceil(F.sqrt(pairs / task_pairs)).alias("cut")))
    total = cells.agg(F.sum("pairs")).first()[0] or 0
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, min(1 << 15, int(2 * total / task_pairs)))

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        """Each row of a side in the squares of its band, dealt to as many tasks as there are pairs for."""
        every = F.explode(F.sequence(F.lit(0), F.col("cut").cast("int") - 1)).alias(other)
        part = F.pmod(F.xxhash64("id"), F.col("cut")).cast("int").alias(own)
        return side.join(cells, ["g", "band"]).select("g", "band", "id", "v", part, every).repartition(tasks, "g", "band", "i", "j")

    left = dealt(rows.withColumn("near", near).withColumn("band", F.col("own") + F.col("near")).drop("own", "near"), "i", "j").withColumnsRenamed({"id": "a", "v": "av"})
    right = dealt(rows.withColumnRenamed("own", "band"), "j", "i").withColumnsRenamed({"id": "b", "v": "bv"})
    apart = F.abs(F.col("av") - F.col("bv"))
    joined = left.join(right, ["g", "band", "i", "j"]).where((F.col("a") != F.col("b")) & (apart <= tolerance + 1e-6))
    # Decimal rounding takes long; it is left to what lies near a half of the last digit.
    scaled = apart * 1e6
    sure = F.abs(scaled - F.floor(scaled) - 0.5) > 1e-3
    gap = F.when(sure, F.floor(scaled + 0.5) / 1e6).otherwise(F.round(apart, 6))
    return joined.where(gap <= tolerance).select(
        F.col("a").alias(row_id), F.col("g").alias(group), F.col("b").alias("other_job"), gap.alias("gap")
    )


def as_of(facts: DataFrame, versions: DataFrame, key: str, at: str, take: list[str]) -> DataFrame:
    """Each fact with the version of its key in force at its time: versions become intervals, then one range join."""
    w = Window.partitionBy(key).orderBy(at)
    held = versions.select(
        F.col(key).alias("_k"), F.col(at).alias("_from"), F.lead(at).over(w).alias("_to"), *[F.col(c) for c in take]
    )
    inside = (F.col(key) == F.col("_k")) & (F.col(at) >= F.col("_from"))
    return facts.join(held, inside & (F.col("_to").isNull() | (F.col(at) < F.col("_to")))).drop("_k", "_from", "_to")


def lineage_depth(df: DataFrame, group: str, node: str, parent: str) -> DataFrame:
    """(group, node, depth, root) by pointer doubling: as many joins as the depth has binary digits. Nodes in a circle of
    parents, or below one, have no depth and no root; they still move when all others have long arrived."""
    none = F.col(parent).isNull()
    at = df.select(group, node, F.coalesce(parent, node).alias("up"), F.when(none, 0).otherwise(1).cast("long").alias("depth"), none.alias("arrived"))
    rounds, most = 0, df.count().bit_length() + 1
    while True:
        rounds += 1
        step = at.select(F.col(group).alias("_g"), F.col(node).alias("_n"), *[F.col(c).alias(f"_{c}") for c in ("up", "depth", "arrived")])
        moved = at.join(step, (F.col(group) == F.col("_g")) & (F.col("up") == F.col("_n")))
        new = cut_lineage(
            moved.select(
                group, node, F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_arrived").alias("arrived"),
                ((F.col("_up") != F.col("up")) & (F.col("_depth") > 0)).alias("moving"),
            )
        )
        at = new.drop("moving")
        if rounds > most or new.where("moving").isEmpty():
            known = lambda c: F.when(F.col("arrived"), F.col(c))
            return at.select(group, node, known("up").alias("root"), known("depth").alias("depth"))


def running_total(df: DataFrame, order: list[str], amount: Column, name: str) -> DataFrame:
    """``df`` with the total of ``amount`` up to and with each row of a total order, without one task for all: range
    partitions are summed within, and each gets the sums of those before it. One sum for each partition reaches the
    driver."""
    dealt = df.withColumn("_amount", amount).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = cut_lineage(dealt.withColumn("_p", F.spark_partition_id()))
    sums = {r["_p"]: r["n"] for r in dealt.groupBy("_p").agg(F.sum("_amount").alias("n")).collect()}
    before, total = {}, 0
    for p in sorted(sums):
        before[p] = total
        total += sums[p]
    offsets = df.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "_p int, _before long")
    own = F.sum("_amount").over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.join(offsets, "_p").withColumn(name, own + F.col("_before")).drop("_p", "_before", "_amount")


def global_row_number(df: DataFrame, order: list[str]) -> DataFrame:
    """Row numbers over a total order, without one task for all."""
    return running_total(df, order, F.lit(1).cast("long"), "row")


def average_ranks(df: DataFrame, column: str) -> DataFrame:
    """(value, rank) of each different value of a column: equal ones share the mean of their places."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("_n"))
    upto = running_total(counts, ["value"], F.col("_n"), "_upto")
    return upto.select("value", (F.col("_upto") - (F.col("_n") - 1) / 2).alias("rank"))


def first_seen(df: DataFrame, position: str, keys: list[str]) -> DataFrame:
    """Keeps a row unless an earlier *kept* row has one of its keys; dropped rows claim none.

    Decided in rounds over the rows in doubt, set at a time: a row is kept once no undecided or kept row before it
    shares a key with it, and dropped once a kept one does. Each round settles the first row of every key at least.
    """
    todo = cut_lineage(df.select(position, *keys))
    kept = todo.limit(0)
    while not todo.isEmpty():
        firsts = todo
        for k in keys:
            least = todo.groupBy(F.col(k).alias("_k")).agg(F.min(position).alias(f"_first_{k}"))
            firsts = firsts.join(least, F.col(k).eqNullSafe(F.col("_k"))).drop("_k")
        sure = firsts
        for k in keys:
            sure = sure.where(F.col(position) == F.col(f"_first_{k}"))
        sure = cut_lineage(sure.select(position, *keys))
        kept = kept.union(sure)
        rest = todo.join(sure.select(position), position, "left_anti")
        for k in keys:
            rest = rest.join(sure.select(F.col(k).alias("_k")).distinct(), F.col(k).eqNullSafe(F.col("_k")), "left_anti")
        todo = cut_lineage(rest)
    return df.join(kept.select(position), position, "left_semi")



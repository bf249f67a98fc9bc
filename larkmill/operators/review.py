"""Review workflow: state transitions, the bounded critique loop, and differences between versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkmill.functions.scores import critique_score
from larkmill.session import cut_lineage

# The allowed transitions.
TRANSITIONS = {
    "pending": ("in_progress", "rejected"),
    "in_progress": ("completed", "accepted", "rejected"),
    "completed": ("accepted", "rejected"),
    "accepted": (),
    "rejected": (),
}


def next_states(status: Column) -> Column:
    known = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]).cast("array<string>"))])
    return F.coalesce(F.try_element_at(known, status), F.array().cast("array<string>"))


def valid_transition(current: Column, new: Column) -> Column:
    """False for unknown states."""
    return F.coalesce(F.array_contains(next_states(current), new), F.lit(False))


def apply_transitions(state: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """State (key, status) after asked transitions (key, new_status), with whether each was taken."""
    joined = state.join(asked, key, "left")
    ok = F.col("new_status").isNotNull() & valid_transition(F.col("status"), F.col("new_status"))
    return joined.select(key, F.when(ok, F.col("new_status")).otherwise(F.col("status")).alias("status"), ok.alias("taken"))


def review_loop(
    resumes: DataFrame, key: str, text: str, rewrite=None, accept: int = 80, most: int = 3, costs: tuple[float, float] = (2.5, 5.0)
) -> DataFrame:
    """Critique, then accept, give up, or rewrite and try again, at most ``most`` times, for all resumes at once.

    (key, version, parent_version, score, status, cost_cents): one row for each version. ``rewrite`` maps a text and
    its version to a new text.
    """
    rewrite = rewrite or (lambda body, version: F.concat(body, F.lit(" [rev "), version.cast("string"), F.lit("]")))
    at = resumes.select(key, F.col(text).alias("body"), F.lit(1).alias("version"), F.lit(None).cast("int").alias("parent_version"), F.lit(0.0).alias("cost_cents"))
    done = None
    for turn in range(1, most + 1):
        scored = at.withColumn("score", critique_score(F.col("body")).cast("long")).withColumn("cost_cents", F.col("cost_cents") + costs[0])
        status = F.when(F.col("score") >= accept, "accepted").when(F.lit(turn >= most), "completed").otherwise("in_progress")
        scored = cut_lineage(scored.withColumn("status", status))
        rows = scored.select(key, "version", "parent_version", "score", "status", "cost_cents")
        done = rows if done is None else done.union(rows)
        if turn < most:
            at = scored.where("status = 'in_progress'").select(
                key, rewrite(F.col("body"), F.col("version") + 1).alias("body"), (F.col("version") + 1).alias("version"),
                F.col("version").alias("parent_version"), (F.col("cost_cents") + costs[1]).alias("cost_cents"),
            )
    return done


def line_diff(pairs: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """Positional difference: (key, line_num, kind, old_line, new_line) of lines added, removed or modified."""
    lines = F.arrays_zip(F.split(old, "\n", -1).alias("a"), F.split(new, "\n", -1).alias("b"))
    n_old, n_new = F.size(F.split(old, "\n", -1)), F.size(F.split(new, "\n", -1))
    rows = pairs.select(key, n_old.alias("n_old"), n_new.alias("n_new"), F.posexplode(lines).alias("pos", "l"))
    kind = F.when(F.col("pos") >= F.col("n_old"), "added").when(F.col("pos") >= F.col("n_new"), "removed").otherwise("modified")
    changed = (F.col("pos") >= F.least("n_old", "n_new")) | (F.col("l.a") != F.col("l.b"))
    return rows.where(changed).select(
        key, (F.col("pos") + 1).cast("long").alias("line_num"), kind.alias("kind"), F.col("l.a").alias("old_line"), F.col("l.b").alias("new_line")
    )

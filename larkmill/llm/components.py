"""Connected components over links between integer nodes.

Links are first contracted: each task joins those it holds, at most about ``most_links``, and hands on one link from
every node to the least it reaches there. If one task could hold all, that is the result. Else large-star and
small-star steps alternate until nothing changes or what is left fits into one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkmill.session import cut_lineage


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0)).alias("s")
    ).first()
    return int(row["n"]), int(row["s"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger (or other) neighbours to its least neighbour. Edges hold u > v."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
    least = least.select("c", F.least("c", "m").alias("m"))
    moved = both.join(least, both["u"] == least["c"])
    if large:
        out = moved.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.union(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    return out.where(F.col("u") > F.col("v")).distinct()


def union(us: np.ndarray, vs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for all nodes that aren't the least themselves."""
    nodes, at = np.unique(np.concatenate([us, vs]), return_inverse=True)
    up = list(range(len(nodes)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in at.reshape(2, -1).T.tolist():
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    roots = np.array([root(x) for x in range(len(nodes))], dtype=np.int64)
    moved = roots != np.arange(len(nodes))
    return nodes[moved], nodes[roots[moved]]


def _contract(edges: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            table = pa.Table.from_batches(held)
            u, v = union(table["u"].to_numpy(), table["v"].to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return edges.repartition(parts).mapInArrow(run, "u long, v long")


def components(links: DataFrame, a: str, b: str, most_links: int = 1_000_000) -> DataFrame:
    """(node, root) for every linked node but the roots themselves; the root is the least node of a component.

    Links may repeat, point either way or lead from a node to itself; null ends are ignored. Only counts and a hash
    sum reach the driver; every round is cut in the shared checkpoint folder.
    """
    known = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = known.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    state = (edges.count(), 0)
    while state[0]:
        parts = -(-state[0] // most_links)
        edges = cut_lineage(_contract(edges, parts))
        if parts == 1:
            break
        edges = cut_lineage(_star(_star(edges, True), False))
        before, state = state, _state(edges)
        if before == state:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))

"""Stateful limits by key: fixed quota windows that reset on use, token buckets and circuit breakers.

A key's calls of a micro-batch are taken as arrays in order of time. Quotas and breakers jump from one change of state to
the next; only the level of a token bucket is carried call by call.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Columns = tuple[np.ndarray, ...]


GROUPS = 2048  # keys are taken together in so many groups: a call of Python for each key would take most of the time


def _folded(
    events: DataFrame, key: str, output: str, state: str, start: tuple, fold: Callable[[tuple, np.ndarray, np.ndarray], tuple[tuple, Columns]]
) -> DataFrame:
    """Folds each key's events in order of time; the state outlives the batches. Keys share a group by their hash, which
    holds the state of each. A group's rows of one micro-batch, which the files for each trigger bound, are held at once."""
    names = [c.split()[0] for c in output.split(", ")]
    fields = [c.split() for c in state.split(", ")]

    def run(_, parts: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(parts))
        states = {}
        if held.exists:
            own, *columns = held.get
            states = dict(zip(own, zip(*columns, strict=True), strict=True))
        own, none = batch[key].fillna(0).to_numpy(np.int64), batch[key].isna().to_numpy()
        order = np.lexsort((batch["event_id"].to_numpy(), batch["s"].to_numpy(), own, none))
        own, none, ids = own[order], none[order], batch["event_id"].to_numpy()[order]
        at, kinds = batch["s"].to_numpy()[order], batch["event_type"].to_numpy()[order]
        cuts = np.flatnonzero((own[1:] != own[:-1]) | (none[1:] != none[:-1])) + 1
        told = []
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(own)], strict=True):
            name = None if none[i] else int(own[i])
            states[name], columns = fold(states.get(name, start), at[i:j], kinds[i:j])
            told.append(columns)
        held.update((list(states), *[list(c) for c in zip(*states.values(), strict=True)]))
        columns = (pd.arrays.IntegerArray(own, none), ids, *map(np.concatenate, zip(*told, strict=True)))
        yield pd.DataFrame(dict(zip(names, columns, strict=True)))

    timed = events.selectExpr(key, "event_id", "event_type", "CAST(unix_timestamp(ts) AS DOUBLE) AS s", f"pmod(xxhash64({key}), {GROUPS}) AS keys")
    kept = ", ".join(["own array<long>", *[f"{name} array<{kind}>" for name, kind in fields]])
    return timed.groupBy("keys").applyInPandasWithState(run, output, kept, "append", "NoTimeout")


def quota(events: DataFrame, key: str, minutes: int, limit: int) -> DataFrame:
    """A window begins with the first call and ends ``minutes`` later; the next call after it begins a new one."""

    def fold(now: tuple, at: np.ndarray, _: np.ndarray) -> tuple[tuple, Columns]:
        begun, used = now
        count, i = np.empty(len(at), np.int64), 0
        while i < len(at):
            if begun < 0 or at[i] > begun + minutes * 60:
                begun, used = float(at[i]), 0
            end = int(np.searchsorted(at, begun + minutes * 60, "right"))
            count[i:end] = used + np.arange(1, end - i + 1)
            used, i = used + end - i, end
        return (begun, used), (count, count <= limit)

    return _folded(events, key, f"{key} long, event_id long, used long, allowed boolean", "begun double, used long", (-1.0, 0), fold)


def token_bucket(events: DataFrame, key: str, size: float, per_second: float | Fraction) -> DataFrame:
    """A call takes a token if there is one; tokens come back with time, up to the size of the bucket. A rate that isn't
    a float of its own, as a token a day, is given as a fraction: its gains are divided, not multiplied by a rounded rate."""
    rate = (per_second.numerator, per_second.denominator) if isinstance(per_second, Fraction) else (per_second, 1)

    def fold(now: tuple, at: np.ndarray, _: np.ndarray) -> tuple[tuple, Columns]:
        level, last = now
        gained = np.diff(at, prepend=at[0] if last < 0 else last) * rate[0] / rate[1]
        left = np.empty(len(at))
        for i, gain in enumerate(gained.tolist()):
            level = min(size, level + gain)
            left[i] = level = level - 1 if level >= 1 else level
        # What a call finds is what the one before left, and the gain since; it was let through if that made a token.
        before = np.minimum(size, np.concatenate([[now[0]], left[:-1]]) + gained)
        return (level, float(at[-1])), (left, before >= 1)

    return _folded(events, key, f"{key} long, event_id long, tokens double, allowed boolean", "tokens double, last double", (size, -1.0), fold)


def circuit_breaker(events: DataFrame, key: str, failures: int, seconds: float, bad: str = "error") -> DataFrame:
    """Opens after so many failures in a row, lets nothing through until the time is over, and closes on a success."""

    def fold(now: tuple, at: np.ndarray, kinds: np.ndarray) -> tuple[tuple, Columns]:
        streak, opened = now
        outcome = np.full(len(at), "rejected", dtype=object)
        failed, i = kinds == bad, 0
        while i < len(at):
            if opened >= 0 and at[i] < opened + seconds:
                i = int(np.searchsorted(at, opened + seconds, "left"))
                continue
            streak = streak + 1 if failed[i] else 0
            outcome[i] = "failed" if failed[i] else "passed"
            opened = float(at[i]) if streak >= failures else -1.0
            i += 1
        return (streak, opened), (outcome,)

    return _folded(events, key, f"{key} long, event_id long, outcome string", "streak long, opened double", (0, -1.0), fold)

"""A cache by key over a stream: entries live for a time, the oldest make room, and events invalidate them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
GROUPS = 509  # users are taken together in so many groups, a prime: each call of Python, and of it to the state, costs milliseconds
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class CacheRules:
    seconds: int = 7 * 86_400  # a week
    capacity: int = 2  # entries of a key
    invalidating: str = "error"  # the kind of event that empties a key's cache


class _Cache(StatefulProcessor):
    """The users of a group, by the remainder of their ids. Its state is one value: user, item and second of each entry, and
    the time of the timer, which removes what the watermark has left behind."""

    def __init__(self, rules: CacheRules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.put = handle.getValueState("put", "users array<long>, items array<string>, at array<long>, timer long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        calls = pd.concat(list(rows))
        own, none = calls["own"].fillna(0).to_numpy(np.int64), calls["own"].isna().to_numpy()
        order = np.lexsort((calls["event_id"].to_numpy(), calls["s"].to_numpy()))
        own, none, ids = own[order], none[order], calls["event_id"].to_numpy()[order]
        users = [None if x else u for u, x in zip(own.tolist(), none.tolist(), strict=True)]
        cache, timer = self._held()
        told = []
        for user, at, item in zip(users, calls["s"].to_numpy()[order].tolist(), calls["event_type"].to_numpy()[order].tolist(), strict=True):
            held = {k: v for k, v in cache.get(user, {}).items() if at < v + self.rules.seconds}
            if item == self.rules.invalidating:
                told.append("cleared")
                held = {}
            elif item in held:
                told.append("hit")
            else:
                told.append("miss")
                held[item] = at
                if len(held) > self.rules.capacity:
                    del held[min(held, key=lambda k: (held[k], k))]
            cache[user] = held
        self._keep(cache, timer)
        yield pd.DataFrame({"user_id": pd.arrays.IntegerArray(own, none), "event_id": ids, "outcome": told})

    def _held(self) -> tuple[dict[int | None, dict[str, int]], int | None]:
        """The entries of each user, and the timer."""
        cache: dict[int | None, dict[str, int]] = {}
        users, items, at, timer = self.put.get() or ([], [], [], None)
        for user, item, second in zip(users, items, at, strict=True):
            cache.setdefault(user, {})[item] = second
        return cache, timer

    def _keep(self, cache: dict[int | None, dict[str, int]], timer: int | None) -> None:
        entries = [(user, item, at) for user, held in cache.items() for item, at in held.items()]
        then = (min(at for _, _, at in entries) + self.rules.seconds) * 1000 if entries else None
        if then != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if then is not None:
                self.handle.registerTimer(then)
        if entries:
            self.put.update((*map(list, zip(*entries, strict=True)), then))
        else:
            self.put.clear()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        expired = expiredTimerInfo.getExpiryTimeInMs()
        now = max(expired, timerValues.getCurrentWatermarkInMs())  # all that is behind it goes at once
        cache, timer = self._held()
        left = {user: {k: v for k, v in held.items() if now < (v + self.rules.seconds) * 1000} for user, held in cache.items()}
        self._keep(left, None if timer == expired else timer)  # the one that expired goes by itself
        return iter(())

    def close(self) -> None:
        pass


def cached(events: DataFrame, delay: str = "1 day", rules: CacheRules = CacheRules()) -> DataFrame:
    """(user_id, event_id, outcome) of each event: hit, miss (then it is put) or cleared. The state is kept in RocksDB,
    for which the session's state store is set; late events within ``delay`` are taken in turn of their micro-batch."""
    events.sparkSession.conf.set(STORE, ROCKS)
    # In the state, ``user_id`` is the remainder that users of a group share; none for those without an id.
    timed = events.withWatermark("ts", delay).selectExpr(
        f"pmod(user_id, {GROUPS}) AS user_id", "user_id AS own", "event_id", "event_type", "ts", "unix_timestamp(ts) AS s"
    )
    return timed.groupBy("user_id").transformWithStateInPandas(_Cache(rules), "user_id long, event_id long, outcome string", "Append", "EventTime")

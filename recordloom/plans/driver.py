"""What stays on the driver beside the tables: caches of answers, a circuit breaker, due times, hooks, and embeddings by a function of the caller's."""

from __future__ import annotations

import time
from collections.abc import Callable, Hashable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Cache:
    """Answers by key for `ttl` seconds, `most` at a time; at the bound the tenth least used goes."""

    def __init__(self, ttl: float = 60.0, most: int = 10_000, clock: Callable[[], float] = time.monotonic):
        self.ttl, self.most, self.clock = ttl, most, clock
        self._kept: dict[Hashable, list] = {}  # value, until, uses

    @staticmethod
    def key(query: str, *rest) -> tuple:
        return (" ".join(query.lower().split()), *(tuple(r) if isinstance(r, list) else r for r in rest))

    def get(self, key: Hashable):
        found = self._kept.get(key)
        if found is None or found[1] < self.clock():
            self._kept.pop(key, None)
            return None
        found[2] += 1
        return found[0]

    def put(self, key: Hashable, value) -> None:
        if key not in self._kept and len(self._kept) >= self.most:
            for k in sorted(self._kept, key=lambda k: self._kept[k][2])[: max(1, self.most // 10)]:
                del self._kept[k]
        self._kept[key] = [value, self.clock() + self.ttl, 0]

    def clear(self) -> None:
        self._kept.clear()


class Breaker:
    """Opens for `rest` seconds after `most` failures of a name within `within` seconds."""

    def __init__(self, most: int = 5, within: float = 60.0, rest: float = 30.0, clock: Callable[[], float] = time.monotonic):
        self.most, self.within, self.rest, self.clock = most, within, rest, clock
        self._failed: dict[str, list[float]] = {}
        self._open: dict[str, float] = {}

    def failed(self, name: str) -> None:
        now = self.clock()
        self._failed[name] = [t for t in self._failed.get(name, []) if now - t <= self.within] + [now]
        if len(self._failed[name]) >= self.most:
            self._open[name], self._failed[name] = now + self.rest, []

    def worked(self, name: str) -> None:
        self._failed.pop(name, None)

    def allows(self, name: str) -> bool:
        return self._open.get(name, 0.0) <= self.clock()


EVERY = {"maintenance": 24 * 3600.0, "reflection": 6 * 3600.0, "consolidation": 12 * 3600.0}


def due(last: dict[str, float], now: float, every: dict[str, float] | None = None) -> list[str]:
    """Jobs that never ran or whose time has come."""
    return [k for k, s in (every or EVERY).items() if now - last.get(k, float("-inf")) >= s]


class Hooks:
    """Functions that are called on store, recall and maintenance; those for store may ask for tags or a level."""

    def __init__(self):
        self._all: dict[str, list] = {"store": [], "recall": [], "maintenance": []}

    def on(self, event: str, call: Callable, tags: set[str] | None = None, level: int | None = None) -> Callable:
        self._all[event].append((call, tags, level))
        return call

    def fire(self, event: str, value, tags: set[str] = frozenset(), level: int | None = None) -> int:
        wanted = [c for c, t, lv in self._all[event] if (t is None or t & tags) and (lv is None or lv == level)]
        for call in wanted:
            call(value)
        return len(wanted)


def embedded(df: DataFrame, text: Column, function: Callable[[list[str]], list[list[float]]], out: str = "embedding") -> DataFrame:
    """df with an embedding of the text by a function of lists of texts; it runs in Arrow batches on the executors."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series(function(s.fillna("").tolist()))

    return df.withColumn(out, run(text))

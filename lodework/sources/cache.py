"""Computed tables kept while what they were computed from is the same, and for no longer than a stated time."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame

# Seconds an index is kept.
VECTOR_TTL, LEXICAL_TTL = 300, 900


@dataclass
class VersionCache:
    """One persisted table per key; built anew when its version changes or its time is over."""

    clock: Callable[[], float] = time.monotonic
    _held: dict[tuple, tuple[str, float, DataFrame]] = field(default_factory=dict)

    def get(self, key: tuple, version: str, ttl: float, build: Callable[[], DataFrame]) -> DataFrame:
        held = self._held.get(key)
        if held and held[0] == version and self.clock() - held[1] < ttl:
            return held[2]
        self.drop(key)
        df = build().persist(StorageLevel.MEMORY_AND_DISK)
        self._held[key] = (version, self.clock(), df)
        return df

    def drop(self, *keys: tuple) -> None:
        """Forgets these keys, or everything."""
        for key in keys or tuple(self._held):
            held = self._held.pop(key, None)
            if held:
                held[2].unpersist()

    def age(self, key: tuple) -> float | None:
        return self.clock() - self._held[key][1] if key in self._held else None

"""Bounded caches for per-word results inside Python workers."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from sys import getsizeof

#: Bytes that a generation of a cache may hold; an entry counts its key, its value and its place in the table.
GENERATION_BYTES = 24 << 20
_PLACE = 100

_held: dict[Hashable, object] = {}


def of_worker(name: Hashable, make: Callable):
    """What ``make`` gave this worker under ``name``, made at first use. Workers are used again by later stages, so
    whatever stands under another name is dropped first: a worker holds one stage's tables only."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


class Memo(dict):
    """Computes missing values; keeps two generations of at most ``limit`` bytes, so its memory is bounded.

    Keys met again in the younger generation survive; results never depend on what is cached.
    """

    def __init__(self, compute: Callable, limit: int = GENERATION_BYTES):
        super().__init__()
        self.compute, self.limit, self.used, self.old = compute, limit, 0, {}

    def _age(self) -> None:
        self.old = dict(self)
        self.clear()
        self.used = 0

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        cost = getsizeof(key) + getsizeof(value) + _PLACE
        if self.used + cost > self.limit:
            self._age()
        self.used += cost
        self[key] = value
        return value

    def fill(self, keys, compute_all: Callable) -> None:
        """Make ``keys`` known, computing the missing ones together: ``compute_all(list)`` gives their values in order.

        The new values may exceed the limit by themselves; callers bound ``keys``.
        """
        missing = [k for k in keys if k not in self and k not in self.old]
        if not missing:
            return
        values = compute_all(missing)
        cost = sum(map(getsizeof, missing)) + sum(map(getsizeof, values)) + _PLACE * len(missing)
        if self.used + cost > self.limit:
            self._age()
        self.used += cost
        self.update(zip(missing, values))

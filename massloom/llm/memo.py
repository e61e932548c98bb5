"""A bounded memory of computed values that keeps what is in use."""
from __future__ import annotations


class Memo(dict):
    """Computes missing values; at ``limit`` entries the older half-life is let go.

    Keys longer than ``longest`` are computed each time.
    """

    def __init__(self, compute, limit: int, longest: int):
        super().__init__()
        self.compute, self.limit, self.longest, self.old = compute, limit, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= self.longest:
            self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value

    def keep_all(self, items) -> None:
        """Keeps computed values at once; what is over the limit by them goes with the next ones."""
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self.update(items)

    def unknown(self, keys: set) -> list:
        return [k for k in keys - self.keys() if k not in self.old]

"""A bounded memory of results on the driver, with an age limit."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable

# Fixed values: (entries, seconds) of the two memories.
SQL_RESULTS, CHART_RESULTS = (300, 1800), (500, 3600)


class Remembered:
    """Least recently read entries go first.

    As in the product, writing at capacity drops the oldest entry even when the key is known, and
    writing a known key does not make it younger.
    """

    def __init__(self, entries: int, seconds: float, clock: Callable[[], float] = time.monotonic):
        self.entries, self.seconds, self.clock = entries, seconds, clock
        self.held: OrderedDict[str, tuple[float, object]] = OrderedDict()

    def get(self, key: str):
        until, value = self.held.get(key, (None, None))
        if until is None:
            return None
        if self.clock() > until:
            del self.held[key]
            return None
        self.held.move_to_end(key)
        return value

    def set(self, key: str, value) -> None:
        if len(self.held) >= self.entries:
            self.held.popitem(last=False)
        self.held[key] = (self.clock() + self.seconds, value)

    def stats(self) -> dict[str, int]:
        return {"size": len(self.held), "most": self.entries}

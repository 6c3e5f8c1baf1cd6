"""Wall-clock profile of nested stages; near free when off."""

from __future__ import annotations

import resource
import time
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager


class Profile:
    """with profile.stage("name", rows=n): ... ; a stage's time is without that of the stages inside it."""

    def __init__(self, on: bool = True):
        self.on, self.own, self.rows, self.open = on, defaultdict(float), defaultdict(int), []
        self.peak: dict[str, int] = {}

    @contextmanager
    def stage(self, name: str, rows: int = 0) -> Iterator[None]:
        if not self.on:
            yield
            return
        began = time.perf_counter()
        self.open.append(0.0)
        try:
            yield
        finally:
            took, inside = time.perf_counter() - began, self.open.pop()
            self.own[name] += took - inside
            self.rows[name] += rows
            self.peak[name] = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10
            if self.open:
                self.open[-1] += took

    def table(self) -> list[tuple[str, float, int, float, int]]:
        """(stage, seconds, rows, rows a second, the driver process's peak MB by its end), the slowest first."""
        return sorted(((n, s, self.rows[n], self.rows[n] / s if s else 0.0, self.peak[n]) for n, s in self.own.items()), key=lambda r: -r[1])

"""Health checks of services: registered by name, silenced, closed, and evaluated at most once in a while."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from rivulet.functions.scalar import VERDICT_RANK
from rivulet.model import HEALTH_STATUS

#: Fixed value: how long a check's result is reused.
CACHE_MS = 1000


@dataclass(frozen=True)
class Status:
    verdict: str
    reason: str | None = None
    as_of_ms: int | None = None


@dataclass
class Check:
    """evaluate() returns a Status, or a verdict's name. A check that fails, or returns nothing, is UNKNOWN."""

    evaluate: Callable[[], Status | str | None]
    clock: Callable[[], float]
    enabled: bool = True
    cache_ms: int = CACHE_MS
    _last: Status | None = None

    def status(self) -> Status:
        now = int(self.clock() * 1000)
        if self._last and self.cache_ms > 0 and now - self._last.as_of_ms < self.cache_ms:
            return self._last
        try:
            found = self.evaluate()
        except Exception as e:
            found = Status("UNKNOWN", f"check threw: {type(e).__name__}")
        if found is None:
            found = Status("UNKNOWN", "check returned nothing")
        found = Status(found) if isinstance(found, str) else found
        self._last = Status(found.verdict, found.reason, now)
        return self._last


@dataclass
class Health:
    clock: Callable[[], float] = time.time
    checks: dict[str, dict[str, Check]] = field(default_factory=dict)

    def register(self, service: str, name: str, evaluate: Callable[[], Status | str | None], cache_ms: int = CACHE_MS) -> Check:
        check = Check(evaluate, self.clock, cache_ms=cache_ms)
        self.checks.setdefault(service, {})[name] = check
        return check

    def close(self, service: str, name: str | None = None) -> None:
        """Removes a check, or all of a service."""
        if name is not None:
            self.checks.get(service, {}).pop(name, None)
        if name is None or not self.checks.get(service):
            self.checks.pop(service, None)

    def status(self, service: str, name: str) -> Status:
        check = self.checks.get(service, {}).get(name)
        return check.status() if check else Status("UNKNOWN", "check not registered")

    def verdict(self, service: str) -> Status:
        """The worst of the service's enabled checks."""
        own = self.checks.get(service, {})
        found = [c.status() for c in own.values() if c.enabled]
        if not found:
            return Status("UNKNOWN", "all checks silenced" if own else "no checks registered", int(self.clock() * 1000))
        return max(found, key=lambda s: VERDICT_RANK[s.verdict])

    def table(self, spark: SparkSession) -> DataFrame:
        """A row for each check, as ``operators.health.rollup`` takes them."""
        rows = [(s, n, (x := c.status()).verdict, x.reason, x.as_of_ms, c.enabled) for s, own in self.checks.items() for n, c in own.items()]
        return spark.createDataFrame(rows, HEALTH_STATUS)

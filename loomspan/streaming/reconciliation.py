"""Level-triggered reconciliation: each micro-batch of hints compares manifests and publishes only real differences."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.manifests import hint_batch, reconcile


@dataclass
class Schedule:
    """When to reconcile: ``dirty`` after a hint, due once ``debounce_ms`` have passed without another; due anyway every
    ``period_ms``. ``begin`` makes what is due pending, ``complete`` ends it: "published" and "unchanged" clear it, "changed" and
    "failed" leave it dirty, after ``retries`` of them in a row only the next hint or period does. Times are the caller's;
    one before the last counts as a regression and is taken as the last."""

    debounce_ms: int = 200
    period_ms: int = 30_000
    retries: int = 3
    now: int = 0
    dirty_at: int | None = None
    hinted_during: bool = False
    pending: bool = False
    failures: int = 0
    last_done: int = 0
    regressions: int = 0

    def _tick(self, now: int) -> int:
        if now < self.now:
            self.regressions += 1
        self.now = max(self.now, now)
        return self.now

    def observe_dirty(self, now: int) -> None:
        self.dirty_at = self._tick(now)
        self.hinted_during = self.hinted_during or self.pending
        self.failures = 0

    def poll(self, now: int) -> str:
        """pending, due, debouncing or idle."""
        now = self._tick(now)
        if self.pending:
            return "pending"
        if now - self.last_done >= self.period_ms:
            return "due"
        if self.dirty_at is None or self.failures > self.retries:
            return "idle"
        return "due" if now - self.dirty_at >= self.debounce_ms else "debouncing"

    def begin(self, now: int) -> bool:
        if self.poll(now) != "due":
            return False
        self.pending, self.hinted_during = True, False
        return True

    def complete(self, outcome: str, now: int) -> None:
        if not self.pending or outcome not in ("published", "unchanged", "changed", "failed"):
            raise ValueError("nothing is pending, or no such outcome")
        now = self._tick(now)
        self.pending, self.last_done = False, now
        if outcome in ("published", "unchanged"):
            self.failures = 0
            self.dirty_at = self.dirty_at if self.hinted_during else None
        else:
            self.failures += 1
            self.dirty_at = now if self.dirty_at is None else self.dirty_at


@dataclass
class Reconciler:
    """``before()`` is the published manifest, ``after()`` the source as it is; ``publish(diff, batch)`` makes the new one
    active and has to be idempotent by batch. Over ``max_hints`` distinct paths or ``max_bytes`` of them, hints only count as
    "everything may have changed". ``log`` has a record a batch."""

    before: Callable[[], DataFrame]
    after: Callable[[], DataFrame]
    publish: Callable[[DataFrame, int], None]
    max_hints: int = 10_000
    max_bytes: int = 1 << 20
    retries: int = 2
    done: set[int] = field(default_factory=set)
    log: list[dict] = field(default_factory=list)

    def __call__(self, hints: DataFrame, batch: int) -> None:
        if batch in self.done:
            return
        own = hints.select("path")
        full = hint_batch(own, self.max_hints, self.max_bytes).first()["full"]
        for attempt in range(self.retries + 1):
            try:
                diff, counters = reconcile(self.before(), self.after(), own.limit(0) if full else own)
                n = diff.count()
                if n:
                    self.publish(diff, batch)
                self.log.append({"batch": batch, "outcome": "published" if n else "unchanged", "differences": n, "full": full, "attempt": attempt} | counters.first().asDict())
                break
            except Exception as e:
                if attempt == self.retries:
                    self.log.append({"batch": batch, "outcome": "failed", "error": str(e)[:200]})
                    raise
        self.done.add(batch)

    def start(self, hints: DataFrame, checkpoint: str, every: str | None = None) -> StreamingQuery:
        """Runs on a stream of hints: at an interval, or until what is there has been processed."""
        w = hints.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
        return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()

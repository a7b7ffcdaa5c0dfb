"""The keyed state of the sync stream: what has arrived of each snapshot."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

READY_SCHEMA = "snapshot string, reason string, n_named long, n_arrived long"
NAMED, ARRIVED = 1, 2


class Arrivals(StatefulProcessor):
    """State of one snapshot. Input rows: ``kind`` (``index`` or ``content``),
    ``file`` (a content file named or arrived; null for an index entry that
    names none), ``folder`` (is the index a folder), ``changed_ms``."""

    def __init__(self, settle_seconds: int):
        self.settle_ms = 1000 * settle_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.files = handle.getMapState("files", "file string", "bits int")
        self.totals = handle.getValueState(
            "totals", "indexed boolean, folder boolean, named long, arrived long, both long, changed_ms long, done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        indexed, folder, named, arrived, both, changed, done = self.totals.get() or (False, False, 0, 0, 0, 0, False)
        bits: dict[str, int] = {}
        for b in rows:
            index = b["kind"] == "index"
            indexed, folder = indexed or bool(index.any()), folder or bool(b["folder"].any())
            changed = max(changed, int(b["changed_ms"].max()))
            # a file named by many entries is one change of its bits
            for bit, files in ((NAMED, b["file"][index]), (ARRIVED, b["file"][~index])):
                for f in files.dropna().unique():
                    bits[f] = bits.get(f, 0) | bit
        if done:
            return
        for f, new in bits.items():
            old = self.files.getValue((f,))[0] if self.files.containsKey((f,)) else 0
            now = old | new
            if now != old:
                self.files.updateValue((f,), (now,))
                named += (now & ~old & NAMED) > 0
                arrived += (now & ~old & ARRIVED) > 0
                both += now == NAMED | ARRIVED
        whole = indexed and named == both and (not folder or arrived == both)
        quiet = indexed and timerValues.getCurrentProcessingTimeInMs() >= changed + self.settle_ms
        if whole or quiet:
            yield self.emit(key, "complete" if whole else "quiet", indexed, folder, named, arrived, both, changed)
            return
        self.totals.update((indexed, folder, named, arrived, both, changed, False))
        if indexed:
            self.look_again(timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        indexed, folder, named, arrived, both, changed, done = self.totals.get() or (False, False, 0, 0, 0, 0, False)
        if not indexed or done:
            return
        if timerValues.getCurrentProcessingTimeInMs() >= changed + self.settle_ms:
            yield self.emit(key, "quiet", indexed, folder, named, arrived, both, changed)
        else:
            self.look_again(timerValues)

    def look_again(self, timerValues) -> None:
        """In the next batch, whenever that is and whatever ``settle_seconds``
        it has: one timer for a snapshot that waits."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1)

    def emit(self, key, reason, indexed, folder, named, arrived, both, changed) -> pd.DataFrame:
        """Say so once; only the totals are kept from then on."""
        self.files.clear()
        self.totals.update((indexed, folder, named, arrived, both, changed, True))
        return pd.DataFrame({"snapshot": [key[0]], "reason": [reason], "n_named": [named], "n_arrived": [arrived]})

    def close(self) -> None:
        pass

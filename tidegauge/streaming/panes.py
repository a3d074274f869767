"""Pane slicing on a stream: late records change one pane and re-emit the windows over it.

State per key is its panes, with partial aggregates by epoch as in the batch form, and
the publications that are due.  The clock of a key is the receipt of its latest record,
or the stream's watermark of receipts if the key falls silent.  When it passes a
window's publication or one of its ticks, the window is composed from its panes and
emitted if records came since; each emission is one revision, the same as the batch's.
Windows whose cut-off has passed are closed: never emitted again, whatever panes they
share with open ones; panes that no open window covers are dropped, and so is the
state of a key that has none left.

Records that come more than ``disorder`` seconds of receipt behind the latest one of
the stream are dropped by the watermark; others behind their key's clock count as
received at the clock.

Cases: as in the batch form; a null value adds nothing to the total.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidegauge.operators.panes import Slicing

#: (window, revision, published_at, n, total)
Revision = tuple[int, int, int, int, float | None]


class PaneState:
    def __init__(self, spec: Slicing) -> None:
        self.spec = spec
        self.panes: dict[int, dict[int, list]] = {}
        #: Window -> epochs with records that are not published.
        self.due: dict[int, set[int]] = {}
        self.revision: dict[int, int] = {}
        self.clock = float("-inf")

    def covering(self, pane: int) -> list[tuple[int, int]]:
        """Windows over a pane, with how many epochs of the pane lie before their own first."""
        s = self.spec
        shift = s.pane // s.tick
        return [(w, (w + s.size - s.pane - pane) // s.pane * shift) for w in range(pane - s.size + s.pane, pane + 1, s.pane) if w % s.slide == 0]

    def at(self, window: int, epoch: int) -> int:
        return window + self.spec.size + self.spec.delay + epoch * self.spec.tick

    def compose(self, window: int, epoch: int) -> tuple[int, float | None]:
        """What the window's panes hold up to an epoch of it."""
        s = self.spec
        n, total = 0, None
        for pane in range(window, window + s.size, s.pane):
            before = (window + s.size - s.pane - pane) // s.pane * (s.pane // s.tick)
            for e, (count, value) in self.panes.get(pane, {}).items():
                if max(0, e - before) <= epoch:
                    n += count
                    if value is not None:
                        total = value if total is None else total + value
        return n, total

    def add(self, event: float, received: float, value: float | None) -> Iterator[Revision]:
        s = self.spec
        received = max(received, self.clock)
        yield from self.advance(received)
        pane = int(event // s.pane * s.pane)
        epoch = max(0, ceil((received - (pane + s.pane + s.delay)) / s.tick))
        open_ = [(w, max(0, epoch - before)) for w, before in self.covering(pane) if max(0, epoch - before) <= s.last_epoch]
        if not open_:
            return
        slot = self.panes.setdefault(pane, {}).setdefault(epoch, [0, None])
        slot[0] += 1
        if value is not None:
            slot[1] = value if slot[1] is None else slot[1] + value
        for w, e in open_:
            self.due.setdefault(w, set()).add(e)

    def advance(self, now: float) -> Iterator[Revision]:
        """Publish what is due before ``now``, forget what can no longer change."""
        s = self.spec
        if now <= self.clock:
            return
        self.clock = now
        ready = sorted((self.at(w, e), w, e) for w, es in self.due.items() for e in es if self.at(w, e) < now)
        for at, w, e in ready:
            self.due[w].discard(e)
            self.revision[w] = self.revision.get(w, -1) + 1
            yield (w, self.revision[w], at, *self.compose(w, e))
        self.due = {w: es for w, es in self.due.items() if es}
        self.revision = {w: r for w, r in self.revision.items() if w + s.size + s.cutoff >= now}
        self.panes = {p: x for p, x in self.panes.items() if p + s.size + s.cutoff >= now}

    def next_due(self) -> float | None:
        """When there is something to do next without a record: a publication, or dropping panes."""
        s = self.spec
        times = [self.at(w, min(es)) for w, es in self.due.items()] + [p + s.size + s.cutoff for p in self.panes]
        return min(times) if times else None


def revisions_stream(records: DataFrame, keys: list[str], spec: Slicing = Slicing(), disorder: float = 600.0) -> DataFrame:
    """(keys, period_start, revision, published_at, n, total) as they are published;
    ``records`` is a stream with the keys, event_time, received and value."""
    kinds = {f.name: f.dataType for f in records.schema}
    schema = S.StructType(
        [S.StructField(k, kinds[k]) for k in keys]
        + [S.StructField(c, S.LongType()) for c in ("period_start", "revision", "published_at", "n")]
        + [S.StructField("total", S.DoubleType())]
    )

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = pickle.loads(bytes(state.get[0])) if state.exists else PaneState(spec)
        found = []
        if state.hasTimedOut:
            found += [(*key, *w) for w in s.advance(state.getCurrentWatermarkMs() / 1000)]
        else:
            pdf = pd.concat(list(frames)).sort_values("received", kind="stable")
            for event, received, value in zip(pdf["event_time"], pdf["received"], pdf["value"]):
                found += [(*key, *w) for w in s.add(float(event), float(received), None if pd.isna(value) else float(value))]
        at = s.next_due()
        if at is None:
            if state.exists:
                state.remove()
        else:
            state.update((pickle.dumps(s),))
            # Strictly after: records received at that very time still belong to it.
            state.setTimeoutTimestamp(max(int(at * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(found, columns=[f.name for f in schema]).astype({"total": "float64"})

    known = ~F.isnan("event_time") & ~F.isnan("received")
    wanted = (
        records.dropna(subset=[*keys, "event_time", "received"])
        .filter(known)
        .select(*keys, "event_time", "received", records["value"].cast("double").alias("value"))
        .withColumn("_received", F.timestamp_micros((F.col("received") * 1e6).cast("bigint")))
        .withWatermark("_received", f"{int(disorder * 1000)} milliseconds")
    )
    return wanted.groupBy(*keys).applyInPandasWithState(step, schema, "panes binary", "append", GroupStateTimeout.EventTimeTimeout)

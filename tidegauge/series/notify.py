"""Delivery of notifications: incidents, a gate against false positives, dialogs.

``Alerter`` is a driver-side service: ``deliver`` takes the notifications of a
micro-batch (bounded by alerts, not by data) in order of time, and ``tick``
moves the clock.  Contacts are callables.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class Contact:
    name: str
    send: Callable[[str, dict], None]
    resend: float | None = None
    give_up: float = 86_400.0


@dataclass
class Dialog:
    contact: Contact
    due: float
    sent: int = 0
    acked: bool = False
    first: float | None = None


@dataclass
class Incident:
    name: str
    start: float
    certainty: float
    timeout: float | None
    params: dict
    dialogs: list[Dialog] = field(default_factory=list)
    stop: float | None = None
    passed: bool = True


class Alerter:
    """Notifications of one name form an incident, opened by a firing one and
    closed by one that no longer fires, or by its timeout."""

    def __init__(self, teams: dict[str, list[Contact]], debounce: float = 0.0, allowed_false: float = 1.0, period: float = 86_400.0) -> None:
        self.teams, self.debounce, self.allowed, self.period = teams, debounce, allowed_false, period
        self.open: dict[str, Incident] = {}
        self.closed: list[Incident] = []
        self.past: deque[tuple[float, float]] = deque()

    def team(self, name: str) -> list[Contact]:
        best = max((p for p in self.teams if name.startswith(p)), key=len, default=None)
        return self.teams[best] if best is not None else []

    def gate(self, now: float, certainty: float) -> bool:
        """Whether the chance of more false positives than allowed stays within a half."""
        while self.past and self.past[0][0] < now - self.period:
            self.past.popleft()
        self.past.append((now, certainty))
        if certainty >= 1:
            return True
        chances = [1.0]
        for _, c in self.past:
            wrong = 1 - min(c, 1.0)
            nxt = [0.0] * (len(chances) + 1)
            for k, p in enumerate(chances):
                nxt[k] += p * (1 - wrong)
                nxt[k + 1] += p * wrong
            chances = nxt
        return sum(chances[int(self.allowed) + 1 :]) <= 0.5

    def notify(self, name: str, time: float, firing: bool = True, certainty: float = 0.5, debounce: float | None = None, timeout: float | None = None, **params: object) -> None:
        self.tick(time)
        i = self.open.get(name)
        if not firing:
            if i is not None:
                self.close(i, time)
            return
        if i is not None:
            i.params |= params
            i.timeout = time + timeout if timeout else i.timeout
            return
        i = Incident(name, time, certainty, time + timeout if timeout else None, dict(params), passed=self.gate(time, certainty))
        wait = self.debounce if debounce is None else debounce
        if i.passed:
            i.dialogs = [Dialog(c, time + wait) for c in self.team(name)]
        self.open[name] = i
        self.tick(time)

    def close(self, i: Incident, time: float) -> None:
        i.stop = time
        del self.open[i.name]
        self.closed.append(i)
        for d in i.dialogs:
            if d.sent:
                d.contact.send(f"{i.name} is over", {"time": time, "firing": False, **i.params})

    def ack(self, name: str, contact: str) -> None:
        for d in self.open[name].dialogs:
            if d.contact.name == contact:
                d.acked = True

    def tick(self, now: float) -> None:
        for i in list(self.open.values()):
            if i.timeout is not None and now >= i.timeout:
                self.close(i, i.timeout)
                continue
            for d in i.dialogs:
                given_up = d.first is not None and now - d.first > d.contact.give_up
                while not d.acked and not given_up and now >= d.due:
                    d.contact.send(f"{i.name} is firing", {"time": d.due, "firing": True, **i.params})
                    d.sent += 1
                    d.first = d.first if d.first is not None else d.due
                    if d.contact.resend is None:
                        d.due = float("inf")
                    else:
                        d.due += d.contact.resend

    def deliver(self, batch: DataFrame, batch_id: int = 0) -> None:
        """A ``foreachBatch`` function for DataFrames with name, start and firing."""
        rest = [c for c in batch.columns if c not in ("name", "start", "firing", "certainty", "timeout")]
        for r in batch.orderBy("start", "name").toLocalIterator():
            more = {k: r[k] for k in ("certainty", "timeout") if k in batch.columns and r[k] is not None}
            self.notify(r["name"], float(r["start"]), bool(r["firing"]), **more, **{c: r[c] for c in rest})

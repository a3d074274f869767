"""Tree of expressions, operations and programs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from tidegauge.lang.types import T


class LanguageError(ValueError):
    """A program that is not well formed or well typed."""


@dataclass
class E:
    """An expression: an operator with operands and attributes.  ``life`` is the
    lifespan of a stateful one, ``nulls`` what it does with nulls."""

    op: str
    args: list[E] = field(default_factory=list)
    at: dict[str, Any] = field(default_factory=dict)
    t: T | None = None

    def walk(self) -> Iterator[E]:
        """Operands before operators."""
        for a in self.args:
            yield from a.walk()
        yield self

    def key(self) -> str:
        return repr((self.op, sorted((k, str(v)) for k, v in self.at.items()), [a.key() for a in self.args]))


@dataclass
class Field:
    expr: E | None
    alias: str
    doc: str = ""
    aggregate: str = ""
    minus: list[str] = field(default_factory=list)

    @property
    def star(self) -> bool:
        return self.expr is None

    @property
    def private(self) -> bool:
        return self.alias.startswith("_")


@dataclass
class EventTime:
    start: E
    stop: E | None = None
    duration: E | None = None


class Sited(str):
    """The name of a parent taken from some sites only: a glob, or "" for this site."""

    site: str


@dataclass
class Aggregate:
    fields: list[Field]
    parents: list[Any] = field(default_factory=list)  # names or nested operations
    where: E | None = None
    keys: list[E] = field(default_factory=list)
    commit: E | None = None
    before: bool = False
    flush: bool = True
    explicit_commit: bool = False
    notify: list[E] = field(default_factory=list)
    sort: tuple[int, E | None, list[E]] | None = None
    every: E | None = None
    event: EventTime | None = None
    factors: list[str] = field(default_factory=list)


@dataclass
class Read:
    """An external source: ``kind`` is files or kafka; format csv or rowbinary."""

    kind: str
    where: Any
    fmt: str
    columns: list[tuple[str, T]]
    options: dict[str, Any] = field(default_factory=dict)


@dataclass
class Listen:
    protocol: str
    port: int | None = None


@dataclass
class Function:
    name: str
    op: Any
    lazy: bool = False
    persist: float | None = None
    best_after: float | None = None


@dataclass
class Parameter:
    name: str
    t: T | None
    default: E | None
    doc: str = ""


@dataclass
class Program:
    functions: list[Function]
    params: dict[str, Parameter] = field(default_factory=dict)
    globals: dict[str, tuple[str, T]] = field(default_factory=dict)
    run_if: E | None = None

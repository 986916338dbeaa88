"""What a query says: a time range and a list of stages."""

from __future__ import annotations

from dataclasses import dataclass, field


class QueryError(ValueError):
    def __init__(self, message: str, position: int = 0):
        super().__init__(f"{message} (at {position})")
        self.position = position


@dataclass(frozen=True)
class Span:
    """A base interval. kind: last (seconds, offset), fixed (lo, hi in ms) or any (parts)."""

    kind: str
    seconds: int = 3600
    offset: int = 0
    lo: int = 0
    hi: int = 0
    parts: tuple[Span, ...] = ()
    #: Minutes of the day, half open, and the weekday (0 Monday) or None.
    daily: tuple[int, int] | None = None
    weekday: int | None = None

    def bounds(self, now_ms: int) -> list[tuple[int, int]]:
        if self.kind == "last":
            hi = now_ms - self.offset * 1000
            return [(hi - self.seconds * 1000, hi)]
        if self.kind == "fixed":
            return [(self.lo, self.hi)]
        return [b for p in self.parts for b in p.bounds(now_ms)]


@dataclass(frozen=True)
class And:
    items: tuple


@dataclass(frozen=True)
class Or:
    items: tuple


@dataclass(frozen=True)
class Not:
    item: object


@dataclass(frozen=True)
class Test:
    """A leaf. fields: any of them may match. op: ip, port, proto, =, !=, <, <=, >, >=, ~, !~, in, between, contains, starts, ends, prefix; negated belongs to the leaf."""

    fields: tuple[str, ...]
    op: str
    values: tuple
    negated: bool = False


@dataclass(frozen=True)
class Item:
    left: str
    op: str | None = None
    right: str | None = None
    alias: str | None = None


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...] = ()
    star: bool = False
    without: tuple[str, ...] = ()


@dataclass(frozen=True)
class Key:
    name: str | None = None
    prefix: int | None = None
    seconds: int | None = None


@dataclass(frozen=True)
class Agg:
    func: str
    field: str | None = None

    @property
    def name(self) -> str:
        return f"{self.func}({self.field or ''})"


@dataclass(frozen=True)
class Group:
    keys: tuple[Key, ...]
    aggs: tuple[Agg, ...] = ()


@dataclass(frozen=True)
class Top:
    n: int
    agg: Agg
    bottom: bool = False


@dataclass(frozen=True)
class Sort:
    agg: Agg
    descending: bool = False


@dataclass(frozen=True)
class Limit:
    n: int


@dataclass(frozen=True)
class Query:
    time: Span = field(default_factory=lambda: Span("last"))
    stages: tuple = ()

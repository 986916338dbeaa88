"""The pipeline query language: text to Query."""

from __future__ import annotations

import re

from .ast import Agg, And, Group, Item, Key, Limit, Not, Or, Query, QueryError, Select, Sort, Span, Test, Top
from .literals import WEEKDAYS, clock, duration, instant, is_day, is_duration, number, port, protocol

FUNCTIONS = ("sum", "avg", "min", "max", "count", "uniq", "p50", "p95", "p99", "stddev", "rate", "first", "last")
_LEX = re.compile(r'\s+|#[^\n]*|(?P<string>"(?:\\.|[^"\\])*")|(?P<mark>!=|!~|>=|<=|\.\.|[|,()=<>~])|(?P<word>(?:(?!\.\.)[^\s|,()="!<>~#])+)|(?P<bad>.)')
_ESCAPES = {"n": "\n", "t": "\t", '"': '"', "\\": "\\"}
_DIRECTIONS = {"src": ("src",), "dst": ("dst",), "ip": ("src", "dst"), "sport": ("sport",), "dport": ("dport",), "port": ("sport", "dport")}


def lex(text: str) -> list[tuple[str, str, int]]:
    """(kind, text, position)."""
    out = []
    for m in _LEX.finditer(text):
        kind = m.lastgroup
        if kind == "bad":
            raise QueryError(f"unexpected {m[0]!r}", m.start())
        if kind == "string":
            out.append((kind, re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[0]), m[0][1:-1], flags=re.S), m.start()))
        elif kind:
            out.append((kind, m[0], m.start()))
    return out


class _Reader:
    def __init__(self, text: str):
        self.tokens, self.at, self.end = lex(text), 0, len(text)

    def peek(self, ahead: int = 0) -> str | None:
        k = self.at + ahead
        return self.tokens[k][1] if k < len(self.tokens) else None

    def kind(self) -> str | None:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else None

    def place(self) -> int:
        return self.tokens[self.at][2] if self.at < len(self.tokens) else self.end

    def sees(self, *words: str) -> bool:
        return self.kind() in ("word", "mark") and (self.peek() or "").lower() in words

    def take(self, *words: str) -> bool:
        if self.sees(*words):
            self.at += 1
            return True
        return False

    def need(self, *words: str) -> str:
        if not self.sees(*words):
            raise QueryError(f"expected {' or '.join(words)}, found {self.peek()!r}", self.place())
        self.at += 1
        return self.tokens[self.at - 1][1].lower()

    def word(self, what: str) -> str:
        if self.kind() not in ("word", "string"):
            raise QueryError(f"expected {what}, found {self.peek()!r}", self.place())
        self.at += 1
        return self.tokens[self.at - 1][1]

    def list_of(self, read) -> tuple:
        out = [read()]
        while self.take(","):
            out.append(read())
        return tuple(out)

    def parens(self, read) -> tuple:
        self.need("(")
        out = self.list_of(read)
        self.need(")")
        return out

    # time

    def time(self) -> Span:
        if self.take("last"):
            seconds = duration(self.word("a duration"), self.place())
            if self.take("offset"):
                return Span("last", seconds, duration(self.word("a duration"), self.place()))
            if self.take("every"):
                duration(self.word("a duration"), self.place())
                return Span("last", seconds)
            weekday = None
            if self.sees("daily", "weekly"):
                if self.need("daily", "weekly") == "weekly":
                    day = self.word("a weekday")[:3].lower()
                    if day not in WEEKDAYS:
                        raise QueryError(f"not a weekday: {day!r}", self.place())
                    weekday = WEEKDAYS.index(day)
                lo = clock(self.word("a time of day"), self.place())
                self.need("..")
                return Span("last", seconds, daily=(lo, clock(self.word("a time of day"), self.place())), weekday=weekday)
            return Span("last", seconds)
        if self.take("at"):
            middle = self.moment()
            sign, width = "+-", "5m"
            if (m := re.fullmatch(r"(\+-|\+|-)(.*)", self.peek() or "")) and self.kind() == "word":
                self.at += 1
                sign, width = m[1], m[2] or self.word("a duration")
            ms = duration(width, self.place()) * 1000
            return Span("fixed", lo=middle - ms * ("-" in sign), hi=middle + ms * ("+" in sign))
        if self.sees("("):
            return Span("any", parts=self.parens(self.time))
        whole = is_day(self.peek() or "")
        lo = self.moment()
        if self.take(".."):
            return Span("fixed", lo=lo, hi=self.moment())
        return Span("fixed", lo=lo, hi=lo + 86_400_000 - 1 if whole and is_day(self.peek(-1) or "") else lo)

    def moment(self) -> int:
        at = self.place()
        text = self.word("a time")
        if is_day(text) and re.fullmatch(r"\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?Z?", self.peek() or ""):
            text += "T" + self.word("a time")
        return instant(text, at)

    # filters

    def filter(self):
        items = [self.both()]
        while self.take("or"):
            items.append(self.both())
        return items[0] if len(items) == 1 else Or(tuple(items))

    def both(self):
        items = [self.negation()]
        while self.take("and"):
            items.append(self.negation())
        return items[0] if len(items) == 1 else And(tuple(items))

    def negation(self):
        return Not(self.negation()) if self.take("not") else self.leaf()

    def leaf(self):
        if self.take("("):
            found = self.filter()
            self.need(")")
            return found
        at = self.place()
        field = self.word("a field")
        low = field.lower()
        plain = not self.sees("=", "!=", ">", ">=", "<", "<=", "~", "!~")
        if low in ("src", "dst", "ip") and plain:
            negated = self.take("not")
            if self.take("in") or self.sees("("):
                return Test(_DIRECTIONS[low], "ip", self.parens(lambda: self.word("an address")), negated)
            return Test(_DIRECTIONS[low], "ip", (self.word("an address"),), negated)
        if low in ("sport", "dport", "port") and plain:
            negated = self.take("not")
            read = lambda: port(self.word("a port"), at)
            values = self.parens(read) if self.take("in") or self.sees("(") else self.list_of(read)
            return Test(_DIRECTIONS[low], "port", values, negated)
        if low == "proto" and plain:
            negated = self.take("not")
            read = lambda: protocol(self.word("a protocol"))
            return Test(("proto",), "proto", self.parens(read) if self.take("in") or self.sees("(") else self.list_of(read), negated)
        negated = self.take("not")
        if self.take("in"):
            return Test((field,), "in", self.parens(lambda: self.word("a value")), negated)
        op = self.need("=", "!=", ">", ">=", "<", "<=", "~", "!~")
        kind, place, value = self.kind(), self.place(), self.word("a value")
        if op not in ("~", "!~") and kind == "word" and re.match(r"\d", value) and re.fullmatch(r"\d+[A-Za-z]*", value):
            value = number(value, place)
        elif op in (">", ">=", "<", "<="):
            value = number(value, place)
        return Test((field,), op.lstrip("!") if op == "!~" else op, (value,), op == "!~")

    # stages

    def agg(self) -> Agg:
        at, func = self.place(), self.word("a function").lower()
        if func not in FUNCTIONS:
            raise QueryError(f"no function {func!r}", at)
        self.need("(")
        field = None if self.sees(")") else self.word("a field")
        self.need(")")
        return Agg(func, field)

    def item(self) -> Item:
        left, op, right, alias = self.word("a field"), None, None, None
        if self.sees("/", "*", "+", "-"):
            op, right = self.need("/", "*", "+", "-"), self.word("a field")
        elif (m := re.fullmatch(r"([A-Za-z_]\w*)([/*+])([A-Za-z_]\w*)", left)):
            left, op, right = m[1], m[2], m[3]
        if self.take("as"):
            alias = self.word("a name")
        return Item(left, op, right, alias)

    def key(self) -> Key:
        text = self.word("a key")
        if is_duration(text):
            return Key(seconds=duration(text))
        if (m := re.fullmatch(r"(\w+)/(\d+)", text)):
            return Key(m[1], int(m[2]))
        if self.kind() == "word" and (m := re.fullmatch(r"/(\d*)", self.peek() or "")):
            self.at += 1
            return Key(text, int(m[1] or self.word("a prefix length")))
        return Key(text)

    def whole(self) -> int:
        at, text = self.place(), self.word("a number")
        if not text.isdigit():
            raise QueryError(f"not a count: {text!r}", at)
        return int(text)

    def stage(self):
        if self.take("select"):
            if self.take("*"):
                return Select(star=True, without=self.parens(lambda: self.word("a field")) if self.take("except") else ())
            return Select(self.list_of(self.item))
        if self.sees("group") and (self.peek(1) or "").lower() == "by":
            self.at += 2
            keys = self.list_of(self.key)
            return Group(keys, self.list_of(self.agg)) if self.take("|") else Group(keys)
        if self.sees("top", "bottom"):
            bottom = self.need("top", "bottom") == "bottom"
            n = self.whole()
            self.need("by")
            return Top(n, self.agg(), bottom)
        if self.take("sort"):
            agg = self.agg()
            return Sort(agg, self.take("desc") or self.take("asc") and False)
        if self.take("limit"):
            return Limit(self.whole())
        return self.filter()


def parse(text: str) -> Query:
    r = _Reader(text)
    time = Span("last") if r.peek() is None or r.sees("|") else r.time()
    stages = []
    while r.peek() is not None:
        r.need("|")
        stages.append(r.stage())
    return Query(time, tuple(stages))

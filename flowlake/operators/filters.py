"""Filter trees to columns.

A test on a missing column or value is false and its negation true. Trees are put in negation normal form, so plain tests
stay plain comparisons that the Parquet scan takes, and only negated ones mention null.
"""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import exprs, tables
from ..plans.ast import And, Not, Or, QueryError, Test


class Fields:
    """Names of a table: aliases and what kind each column is."""

    def __init__(self, df: DataFrame, aliases: dict[str, str] | None = None):
        self.types = dict(df.dtypes)
        self.aliases = tables.ALIASES | (aliases or {})
        self._lower = {c.lower(): c for c in df.columns}

    def name(self, field: str) -> str:
        if field in self.types:
            return field
        known = self.aliases.get(field) or self.aliases.get(field.lower()) or field
        return self._lower.get(known.lower(), known)

    def has(self, field: str) -> bool:
        return self.name(field) in self.types

    def kind(self, field: str) -> str:
        name = self.name(field)
        if "IPv4" in name and self.types.get(name) in ("bigint", "int"):
            return "ip4"
        if "MacAddress" in name:
            return "mac"
        return {"string": "text", "boolean": "flag", "binary": "bytes"}.get(self.types.get(name, ""), "number")


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _address(value: str):
    """4 or 6: of the literal's family."""
    return 6 if ":" in value else 4


def _leaf(test: Test, field: str, fields: Fields) -> list[tuple[str, Column]]:
    """(column, positive test) of each column that the field stands for."""
    name = fields.name(field)
    c = F.col(name)
    kind = fields.kind(field)
    if test.op == "ip":
        out = []
        for family, column, test_of in ((4, name, exprs.ipv4_in), (6, tables.IPV6_OF.get(name, name), exprs.ipv6_in)):
            values = [str(v) for v in test.values if _address(str(v)) == family]
            if values and column in fields.types:
                try:
                    plain = family == 4 and all(v.replace(".", "").isdigit() for v in values) and len(values) > 1
                    found = F.col(column).isin(*[int(ipaddress.IPv4Address(v)) for v in values]) if plain else _any([test_of(F.col(column), v) for v in values])
                except ValueError as e:
                    raise QueryError(str(e)) from None
                out.append((column, found))
        return out
    if name not in fields.types:
        return []
    if test.op == "port":
        single = [lo for lo, hi in test.values if lo == hi]
        parts = ([c == single[0]] if len(single) == 1 else [c.isin(*single)] if single else []) + [c.between(lo, hi) for lo, hi in test.values if lo != hi]
        return [(name, _any(parts))]
    if test.op == "proto":
        return [(name, c == test.values[0] if len(test.values) == 1 else c.isin(*test.values))]
    values = list(test.values)
    if kind == "mac":
        digits = exprs.mac_digits(c)
        plain = ["".join(x for x in str(v) if x in "0123456789abcdefABCDEF").lower() for v in values]
        ops = {"=": lambda: digits == plain[0], "!=": lambda: digits != plain[0], "in": lambda: digits.isin(*plain), "prefix": lambda: digits.startswith(plain[0]), "starts": lambda: digits.startswith(plain[0]), "ends": lambda: digits.endswith(plain[0])}
        if test.op in ops:
            return [(name, ops[test.op]())]
        c = exprs.format_mac(c)
    elif kind == "ip4" and test.op in ("=", "!=", "in"):
        found = _any([exprs.ipv4_in(c, str(v)) for v in values])
        return [(name, ~found if test.op == "!=" else found)]
    elif kind == "number" and test.op in ("=", "!=", "in"):
        values = [float(v) if "." in str(v) else int(v) for v in values]
    elif kind == "flag":
        values = [v if isinstance(v, bool) else str(v).lower() == "true" for v in values]
    elif kind == "text" and test.op in ("=", "!=", "in"):
        values = [str(v) for v in values]
    elif kind not in ("text",) and test.op in ("~", "contains", "starts", "ends", "prefix"):
        c = exprs.dotted(c) if kind == "ip4" else c.cast("string")
    v = values[0]
    found = {
        "=": lambda: c == v, "!=": lambda: c != v, ">": lambda: c > v, ">=": lambda: c >= v, "<": lambda: c < v, "<=": lambda: c <= v,
        "~": lambda: c.rlike(str(v)), "contains": lambda: c.contains(str(v)), "starts": lambda: c.startswith(str(v)), "prefix": lambda: c.startswith(str(v)), "ends": lambda: c.endswith(str(v)),
        "in": lambda: c.isin(*values), "between": lambda: c.between(values[0], values[1]),
    }[test.op]()
    return [(name, found)]


def compile_filter(tree, fields: Fields, negate: bool = False) -> Column:
    if isinstance(tree, Not):
        return compile_filter(tree.item, fields, not negate)
    if isinstance(tree, (And, Or)):
        parts = [compile_filter(x, fields, negate) for x in tree.items]
        return reduce((lambda a, b: a & b) if isinstance(tree, And) != negate else (lambda a, b: a | b), parts)
    assert isinstance(tree, Test)
    per_field = []
    for field in tree.fields:
        found = _leaf(tree, field, fields)
        if not found:
            per_field.append(F.lit(negate))
            continue
        if tree.negated:
            # Each column that is there must differ.
            one = [(n, ~t) for n, t in found]
            test, names = reduce(lambda a, b: a & b, [t for _, t in one]), [n for n, _ in one]
        else:
            test, names = _any([t for _, t in found]), [n for n, _ in found]
        if negate:
            test = reduce(lambda a, b: a & b, [F.col(n).isNull() | ~t for n, t in (one if tree.negated else found)]) if not tree.negated else _any([F.col(n).isNull() for n in names]) | ~test
        per_field.append(test)
    return reduce((lambda a, b: a & b) if negate else (lambda a, b: a | b), per_field)

"""The JSON form of queries: a dict to Query."""

from __future__ import annotations

from .ast import Agg, And, Group, Item, Key, Limit, Not, Or, Query, QueryError, Select, Sort, Span, Test, Top
from .literals import duration, instant, is_duration, number, port, protocol

_PLAIN = {"eq": "=", "ne": "!=", "gt": ">", "ge": ">=", "lt": "<", "le": "<="}
_TEXT = {"regex": ("~", False), "not_regex": ("~", True), "contains": ("contains", False), "not_contains": ("contains", True), "starts_with": ("starts", False), "ends_with": ("ends", False), "prefix": ("prefix", False)}
_IPS = {"src": ("src",), "dst": ("dst",), "ip": ("src", "dst")}
_PORTS = {"sport": ("sport",), "dport": ("dport",), "port": ("sport", "dport"), "sourceTransportPort": ("sport",), "destinationTransportPort": ("dport",)}
_PROTO = ("proto", "protocolIdentifier")


def _listed(value) -> list:
    return list(value) if isinstance(value, (list, tuple)) else [v.strip() for v in str(value).split(",")]


def _is_address_field(field: str) -> bool:
    return field in _IPS or "IPv4Address" in field or "IPv6Address" in field or field in ("nexthop", "nexthop6", "exporter")


def _test(f: dict) -> object:
    try:
        field, op, value = f["field"], f["op"], f.get("value")
    except KeyError as e:
        raise QueryError(f"a filter needs {e}") from None
    negated = op in ("ne", "not_in")
    if _is_address_field(field) and op not in _TEXT:
        if op == "ip_range":
            lo, hi = _listed(value) if isinstance(value, (list, tuple)) or "-" not in str(value) else str(value).split("-")
            return Test(_IPS.get(field, (field,)), "ip", (f"{str(lo).strip()}-{str(hi).strip()}",))
        values = _listed(value) if op in ("in", "not_in") else [value]
        return Test(_IPS.get(field, (field,)), "ip", tuple(map(str, values)), negated)
    if field in _PORTS or field in _PROTO:
        if op in _TEXT:
            raise QueryError(f"{op} does not apply to {field}")
        fields = _PORTS.get(field, ("proto",))
        if op in ("gt", "ge", "lt", "le"):
            found = [Test((x,), _PLAIN[op], (number(str(value)),)) for x in fields]
            return found[0] if len(found) == 1 else Or(tuple(found))
        if op in ("between", "port_range"):
            lo, hi = value if isinstance(value, (list, tuple)) else str(value).split("-")
            return Test(fields, "port", ((int(lo), int(hi)),))
        values = _listed(value) if op in ("in", "not_in") else [value]
        return Test(fields, "port", tuple(port(str(v)) for v in values), negated) if field in _PORTS else Test(fields, "proto", tuple(protocol(str(v)) for v in values), negated)
    if op in _TEXT:
        name, no = _TEXT[op]
        return Test((field,), name, (str(value),), no)
    if op == "between":
        lo, hi = value
        return Test((field,), "between", (number(str(lo)), number(str(hi))))
    if op in ("in", "not_in"):
        return Test((field,), "in", tuple(_listed(value)), negated)
    if op not in _PLAIN:
        raise QueryError(f"no operator {op!r}")
    if isinstance(value, str) and value[:1].isdigit() and op not in ("eq", "ne"):
        value = number(value)
    return Test((field,), _PLAIN[op], (value,))


def _filter(f: dict):
    if "filters" in f:
        parts = tuple(_filter(x) for x in f["filters"])
        found = Or(parts) if f.get("logic", "and") == "or" else And(parts)
    else:
        found = _test(f)
    return Not(found) if f.get("negated") else found


def _agg(a: dict) -> Agg:
    return Agg(str(a["function"]).lower(), a.get("field"))


def _time(t: dict | None) -> Span:
    if not t:
        return Span("last")
    if t["type"] == "relative":
        return Span("last", duration(t["duration"]))
    if t["type"] == "absolute":
        return Span("fixed", lo=instant(t["start"]), hi=instant(t["end"]))
    raise QueryError(f"no time range of type {t['type']!r}")


def _key(text: str) -> Key:
    if is_duration(text):
        return Key(seconds=duration(text))
    name, _, prefix = text.partition("/")
    return Key(name.strip(), int(prefix)) if prefix else Key(name)


def from_json(q: dict) -> Query:
    stages: list = []
    if q.get("filters"):
        stages.append(_filter({"filters": q["filters"], "logic": q.get("logic", "and")}))
    if q.get("columns"):
        stages.append(Select(tuple(Item(c) for c in q["columns"])))
    a = q.get("aggregate")
    if a:
        kind = a.get("type")
        if kind == "top_n":
            stages.append(Top(int(a["n"]), _agg(a), bool(a.get("bottom"))))
        elif kind == "group_by":
            stages.append(Group(tuple(_key(k) for k in a["keys"]), tuple(_agg(f) for f in a.get("functions", ()))))
        elif kind == "sort":
            stages.append(Sort(_agg(a), a.get("direction", "desc") == "desc"))
        elif kind == "limit":
            stages.append(Limit(int(a["n"])))
        else:
            raise QueryError(f"no aggregate of type {kind!r}")
    if q.get("sort"):
        stages.append(Sort(Agg(q["sort"].get("function", "sum"), q["sort"]["field"]), q["sort"].get("direction", "desc") == "desc"))
    return Query(_time(q.get("time_range")), tuple(stages))

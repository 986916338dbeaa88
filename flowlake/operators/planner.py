"""A Query over a table of flows as one lazy DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import exprs
from ..plans.ast import Agg, Group, Item, Limit, Query, QueryError, Select, Sort, Span, Top
from ..plans.fql import parse
from .filters import Fields, compile_filter


@dataclass(frozen=True)
class Layout:
    """What a table's columns mean. partitions: hour partition columns, if the table has them."""

    time: str = "sysExportTime"
    row: str = "sysRowId"
    partitions: tuple[str, ...] = ()


def time_filter(span: Span, now_ms: int, layout: Layout) -> Column:
    t, found = F.col(layout.time), None
    for lo, hi in span.bounds(now_ms):
        part = t.between(lo, hi)
        if layout.partitions:
            # Catalyst can't derive hours from milliseconds, so the partition filter is given too.
            at = lambda ms: F.lit(ms // 3_600_000)
            y, m, d, h = (F.col(c) for c in layout.partitions)
            hour = (F.unix_seconds(F.make_timestamp(y, m, d, h, F.lit(0), F.lit(0), F.lit("UTC"))) / 3600).cast("long")
            part = part & hour.between(at(lo), at(hi)) & y.between(*_years(lo, hi))
        found = part if found is None else found | part
    for s in (span, *span.parts):
        if s.daily:
            minutes = F.pmod(F.floor(t / 60_000), F.lit(1440))
            found = found & (minutes >= s.daily[0]) & (minutes < s.daily[1])
            if s.weekday is not None:
                found = found & (F.pmod(F.floor(t / 86_400_000) + 3, F.lit(7)) == s.weekday)
    return found


def _years(lo: int, hi: int) -> tuple[int, int]:
    year = lambda ms: 1970 + int(ms // 31_556_952_000)
    return year(lo) - 1, year(hi) + 1


def aggregate(agg: Agg, fields: Fields, layout: Layout, seconds: float, approximate: bool = False) -> Column:
    """approximate: uniq and percentiles by sketches, whose memory does not grow with the values."""
    if agg.func == "count":
        return F.count(F.lit(1))
    name = fields.name(agg.field or "")
    c = F.col(name) if name in fields.types else F.lit(None).cast("long")
    order = F.struct(layout.time, layout.row)
    if approximate and agg.func in ("uniq", "p50", "p95", "p99"):
        return F.approx_count_distinct(c, 0.01) if agg.func == "uniq" else F.percentile_approx(c, int(agg.func[1:]) / 100, 10_000)
    return {
        "sum": lambda: F.sum(c), "avg": lambda: F.avg(c), "min": lambda: F.min(c), "max": lambda: F.max(c), "uniq": lambda: F.count_distinct(c),
        "p50": lambda: F.percentile(c, 0.5), "p95": lambda: F.percentile(c, 0.95), "p99": lambda: F.percentile(c, 0.99), "stddev": lambda: F.stddev_samp(c),
        "rate": lambda: F.sum(c) / F.lit(float(seconds)), "first": lambda: F.min_by(c, order), "last": lambda: F.max_by(c, order),
    }[agg.func]()


def _keys(group: Group, fields: Fields, layout: Layout) -> list[Column]:
    out = []
    for k in group.keys:
        if k.seconds:
            out.append(exprs.bucket(F.col(layout.time), k.seconds).alias("time_bucket"))
            continue
        name = fields.name(k.name)
        if name not in fields.types:
            out.append(F.lit(None).cast("string").alias(k.name))
        elif k.prefix is None:
            out.append(F.col(name))
        else:
            out.append((exprs.subnet6 if fields.types[name] == "binary" else exprs.subnet)(F.col(name), k.prefix).alias(f"{name}/{k.prefix}"))
    return out


def _item(item: Item, fields: Fields) -> Column:
    def col(n: str) -> Column:
        return F.col(fields.name(n)) if fields.has(n) else F.lit(None).cast("double" if item.op else "string")

    if not item.op:
        return col(item.left).alias(item.alias or fields.name(item.left))
    a, b = col(item.left).cast("double"), col(item.right).cast("double")
    value = {"/": lambda: F.try_divide(a, b), "*": lambda: a * b, "+": lambda: a + b, "-": lambda: a - b}[item.op]()
    return value.alias(item.alias or f"{item.left}{item.op}{item.right}")


def _select(df: DataFrame, select: Select | None, fields: Fields) -> DataFrame:
    if select is None or select.star:
        gone = {fields.name(f) for f in select.without} if select else set()
        return df.select(*[F.col(f"`{c}`") for c in sorted(df.columns) if c not in gone])
    return df.select(*[_item(i, fields) for i in select.items])


def plan(query: Query | str, df: DataFrame, layout: Layout = Layout(), now_ms: int = 0, cursor: str | None = None, limit: int | None = None, offset: int = 0, bounds: tuple[int, int] | None = None, sort_cap: int | None = None, approximate: bool = False, row_guard: int | None = None) -> DataFrame:
    """The result of a query. bounds pins the time range, cursor continues below a row id, limit and offset page rows; sort_cap limits a sort without a limit; approximate takes sketches for uniq and percentiles; row_guard refuses (QueryError) to group or order more rows, after a count of them."""
    query = parse(query) if isinstance(query, str) else query
    fields = Fields(df)
    span = Span("fixed", lo=bounds[0], hi=bounds[1]) if bounds else query.time
    rows = df.where(time_filter(span, now_ms, layout))
    stages = list(query.stages)
    for s in stages:  # filters stand before aggregation wherever they are written
        if not isinstance(s, (Select, Group, Top, Sort, Limit)):
            rows = rows.where(compile_filter(s, fields))
    if cursor is not None:
        rows = rows.where(F.col(layout.row) < cursor)
    group = next((s for s in reversed(stages) if isinstance(s, Group)), None)
    order = next((s for s in reversed(stages) if isinstance(s, (Top, Sort))), None)
    cut = next((s.n for s in reversed(stages) if isinstance(s, Limit)), None)
    if row_guard is not None and (group or order) and (n := rows.count()) > row_guard:
        raise QueryError(f"{n} rows match, more than the limit of {row_guard}: narrow the time range or add filters")
    if group:
        return _grouped(rows, group, order, cut, fields, layout, span, now_ms, approximate)
    newest = [F.col(layout.time).desc(), F.col(layout.row).desc()]
    if isinstance(order, (Top, Sort)):
        down = order.descending if isinstance(order, Sort) else not order.bottom
        by = [F.col(fields.name(order.agg.field)).desc() if down else F.col(fields.name(order.agg.field)).asc_nulls_last()] if order.agg.field and fields.has(order.agg.field) else []
        n = order.n if isinstance(order, Top) else sort_cap if cut is None else cut
        rows = rows.orderBy(*by, *newest)
        if n is not None:
            rows = rows.limit(min(n, cut) if cut is not None else n)
    else:
        rows = rows.orderBy(*newest)
        if cut is not None:
            rows = rows.limit(cut)
    if offset:
        rows = rows.offset(offset)
    if limit is not None:
        rows = rows.limit(limit)
    return _select(rows, next((s for s in stages if isinstance(s, Select)), None), fields)


def _grouped(rows: DataFrame, group: Group, order, cut, fields: Fields, layout: Layout, span: Span, now_ms: int, approximate: bool) -> DataFrame:
    step = next((k.seconds for k in group.keys if k.seconds), None)
    seconds = step or max(1.0, sum(hi - lo for lo, hi in span.bounds(now_ms)) / 1000)
    keys = _keys(group, fields, layout)
    aggs = list(dict.fromkeys(group.aggs))
    extra = [order.agg] if order and order.agg not in aggs else []
    if not aggs and not extra:
        out = rows.select(*keys).distinct()
    else:
        out = rows.groupBy(*keys).agg(*[aggregate(a, fields, layout, seconds, approximate).alias(a.name) for a in (*aggs, *extra)])
    names = out.columns[: len(keys)]
    by = order.agg.name if order else aggs[0].name if aggs else None
    down = not order or (order.descending if isinstance(order, Sort) else not order.bottom)
    if by:
        out = out.orderBy(F.col(f"`{by}`").desc() if down else F.col(f"`{by}`").asc(), *[F.col(f"`{n}`") for n in names])
    if isinstance(order, Top):
        out = out.limit(order.n)
    if cut is not None:
        out = out.limit(cut)
    return out.drop(*[a.name for a in extra])


def steps(query: Query | str, now_ms: int = 0) -> list[dict]:
    """The logical steps of a query, for people."""
    query = parse(query) if isinstance(query, str) else query
    return [{"step": "time", "bounds": query.time.bounds(now_ms)}, *({"step": type(s).__name__.lower(), "detail": repr(s)} for s in query.stages)]

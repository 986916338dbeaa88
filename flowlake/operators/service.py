"""Answers as plain dicts, for whatever carries them: queries with pages, a result cache, counters, histogram events, the schema.

A Service holds no rows beyond its cache, which is bounded in entries, bytes and age. Pages come to the driver; whole results
are DataFrames (planner.plan).
"""

from __future__ import annotations

import json
import time
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.ast import Group, Query, QueryError, Select, Sort, Top
from ..plans.fql import parse
from ..plans.structured import from_json
from . import catalog, histogram as hist
from .planner import Layout, plan, steps

COUNTERS = ("requests", "errors", "cache_hits", "cache_misses", "rows_returned")


class ResultCache:
    """Latest answers by key: dropped when old, when the table's version has changed, and the least used first beyond the bounds."""

    def __init__(self, entries: int = 500, size: int = 128 << 20, age: float = 2.0, clock: Callable[[], float] = time.monotonic):
        self.entries, self.size, self.age, self.clock = entries, size, age, clock
        self.used = 0
        self._held: OrderedDict[str, tuple[str, int, float, object]] = OrderedDict()

    def __len__(self) -> int:
        return len(self._held)

    def drop(self, key: str) -> None:
        if key in self._held:
            self.used -= len(self._held.pop(key)[0])

    def get(self, key: str, version: object = None) -> dict | None:
        if key not in self._held:
            return None
        text, _, at, of = self._held[key]
        if of != version or self.clock() - at >= self.age:
            self.drop(key)
            return None
        self._held.move_to_end(key)
        return json.loads(text)

    def put(self, key: str, answer: dict, version: object = None) -> None:
        """An answer larger than the whole cache isn't kept."""
        text = json.dumps(answer)
        self.drop(key)
        if len(text) > self.size or not self.entries:
            return
        while len(self._held) >= self.entries or self.used + len(text) > self.size:
            self.drop(next(iter(self._held)))
        self._held[key] = (text, len(text), self.clock(), version)
        self.used += len(text)


def _plain(value):
    """A row's value as JSON has it: bytes as hexadecimal digits."""
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return value if value is None or isinstance(value, (bool, int, float, str)) else str(value)


@dataclass
class Service:
    """source makes the table anew for each query, version tells when it has changed (any value that can be compared)."""

    source: Callable[[], DataFrame]
    layout: Layout = field(default_factory=Layout)
    version: Callable[[], object] = lambda: None
    now_ms: Callable[[], int] = lambda: time.time_ns() // 1_000_000
    cache: ResultCache = field(default_factory=ResultCache)
    largest_page: int = 10_000
    row_guard: int | None = None
    counters: dict[str, int] = field(default_factory=lambda: dict.fromkeys(COUNTERS, 0))

    def query(self, request: str | dict) -> dict:
        """The answer to a query text or a dict: query (text) or the JSON form, with limit, offset, cursor, time_start and time_end (ms, pinned), schema_columns (pinned), count (with the total). A query that can't be read or run answers with error, and position if known."""
        self.counters["requests"] += 1
        asked = {"query": request} if isinstance(request, str) else dict(request)
        try:
            query = parse(asked["query"]) if "query" in asked else from_json(asked)
            key, version = json.dumps(asked, sort_keys=True, default=str), self.version()
            paged = asked.get("cursor") is not None
            found = None if paged else self.cache.get(key, version)
            if found is not None:
                self.counters["cache_hits"] += 1
                found["stats"]["cached"] = True
                return found
            self.counters["cache_misses"] += 1
            answer = self._answer(query, asked)
        except QueryError as e:
            self.counters["errors"] += 1
            return {"error": str(e), "position": e.position}
        except (PySparkException, KeyError, TypeError, ValueError) as e:
            self.counters["errors"] += 1
            return {"error": str(e).splitlines()[0] if str(e) else type(e).__name__, "position": None}
        if not paged:
            self.cache.put(key, answer, version)
        return answer

    def _answer(self, query: Query, asked: dict) -> dict:
        began, now = time.monotonic(), self.now_ms()
        pinned = (int(asked["time_start"]), int(asked["time_end"])) if "time_start" in asked and "time_end" in asked else None
        bounds = [pinned] if pinned else query.time.bounds(now)
        size, offset = max(1, min(int(asked.get("limit", 100)), self.largest_page)), max(0, int(asked.get("offset", 0)))
        df = self.source()
        grouped = any(isinstance(s, Group) for s in query.stages)
        keyset = not grouped and not any(isinstance(s, (Top, Sort)) for s in query.stages)
        how = {"layout": self.layout, "now_ms": now, "bounds": pinned, "row_guard": self.row_guard}
        if grouped:
            out = plan(query, df, **how).offset(offset).limit(size + 1)
            shown = out.columns
        else:
            # The row's id is asked for beside what is shown, since it continues the page.
            shown = plan(query, df, layout=self.layout, now_ms=now, bounds=pinned).columns
            select = next((s for s in query.stages if isinstance(s, Select)), None)
            stages = tuple(catalog.with_row(s, self.layout.row) if s is select else s for s in query.stages)
            out = plan(Query(query.time, stages), df, cursor=asked.get("cursor"), limit=size + 1, offset=offset, **how)
        rows = out.collect()
        more = len(rows) > size
        rows = rows[:size]
        pins = list(asked.get("schema_columns") or shown)
        at = {c: k for k, c in enumerate(out.columns)}
        cursor_at = out.columns.index(catalog.ROW_MARK) if catalog.ROW_MARK in out.columns else at.get(self.layout.row)
        total = hist.total(query, df, self.layout, now_ms=now, bounds=pinned).first()["total"] if asked.get("count") else offset + len(rows) + more
        self.counters["rows_returned"] += len(rows)
        return {
            "parsed": steps(query, now),
            "columns": [{"name": c, "type": catalog.result_type(c)} for c in pins],
            "rows": [[_plain(r[at[c]]) if c in at else None for c in pins] for r in rows],
            "stats": {"execution_time_us": int((time.monotonic() - began) * 1e6), "rows_returned": len(rows), "cached": False},
            "explain": steps(query, now),
            "pagination": {"offset": offset, "limit": size, "total": total, "has_more": more},
            "time_range": {"start": min(lo for lo, _ in bounds), "end": max(hi for _, hi in bounds)},
            "schema_columns": pins,
            "next_cursor": _plain(rows[-1][cursor_at]) if keyset and more and cursor_at is not None else None,
        }

    def histogram(self, request: dict, parts: int = 8) -> Iterator[dict]:
        """Events with buckets, total_rows, time_range, bucket_ms and done: the range is counted in parts of whole buckets, latest first, so that each event has the buckets known so far; the last has all."""
        try:
            query = from_json({k: request[k] for k in ("time_range", "filters", "logic") if k in request})
            lo, hi = query.time.bounds(self.now_ms())[0]
            target = int(request.get("buckets") or 60)
            where = query.stages[0] if query.stages else None
        except (QueryError, KeyError, TypeError, ValueError) as e:
            self.counters["errors"] += 1
            yield {"error": str(e), "done": True}
            return
        df, known = self.source(), {}
        for begin, end, width, last in hist.progressive(lo, hi, target, parts):
            for r in hist.histogram(df, begin, end, where=where, layout=self.layout, width=width).collect():
                known[r["bucket"]] = r["count"]
            yield {"buckets": [{"timestamp": b, "count": known[b]} for b in sorted(known)], "total_rows": sum(known.values()), "time_range": {"start": lo, "end": hi}, "bucket_ms": width, "done": last}

    def schema(self) -> dict:
        """What can be asked: filter_types (kind to tests), fields, op_hints."""
        return {"filter_types": {k: list(v) for k, v in catalog.FILTER_TYPES.items()}, "fields": catalog.schema_fields(self.source()), "op_hints": dict(catalog.OP_HINTS)}

    def health(self) -> dict:
        return {"status": "ok", "metrics": dict(self.counters), "cache": {"entries": len(self.cache), "used_bytes": self.cache.used, "max_bytes": self.cache.size}}

    def prometheus(self) -> str:
        return "".join(f"# TYPE flowlake_{n} counter\nflowlake_{n} {v}\n" for n, v in self.counters.items())


def events(answers: Iterator[dict]) -> Iterator[str]:
    """Server-sent events of histogram answers."""
    for a in answers:
        yield f"event: progress\ndata: {json.dumps(a)}\n\n"


def storage_stats(spark: SparkSession, path: str) -> DataFrame:
    """files and bytes of each hour of a stored table, from the file system's listing alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path).select("path", "length")
    hour = F.regexp_extract("path", r"year=(\d+)/month=(\d+)/day=(\d+)/hour=(\d+)", 0)
    return files.groupBy(hour.alias("hour")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))

"""Counts over time, row lookup, pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .filters import Fields, compile_filter
from .planner import Layout, plan

# Bucket widths in ms.
WIDTHS = (1000, 5000, 10000, 15000, 30000, 60000, 120000, 300000, 600000, 900000, 1800000, 3600000, 7200000, 21600000, 43200000, 86400000)


def bucket_width(lo: int, hi: int, target: int = 60) -> int:
    """The first width that needs no more than target buckets; a day if none does."""
    return next((w for w in WIDTHS if w * target >= hi - lo), WIDTHS[-1])


def histogram(df: DataFrame, lo: int, hi: int, target: int = 60, where=None, layout: Layout = Layout(), width: int | None = None) -> DataFrame:
    """bucket (start, ms) and count of every bucket from the one that holds lo up to hi, empty ones too."""
    width = width or bucket_width(lo, hi, target)
    first = lo // width * width
    last = (hi - 1) // width * width if hi > lo else first - width
    t = F.col(layout.time)
    rows = df.where(t.between(first, last + width - 1))
    if where is not None:
        rows = rows.where(compile_filter(where, Fields(df)))
    counts = rows.groupBy((F.floor(t / width) * width).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    n = (last - first) // width + 1
    every = df.sparkSession.range(n).select((F.lit(first) + F.col("id") * width).alias("bucket"))
    return every.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("count"))


def progressive(lo: int, hi: int, target: int = 60, parts: int = 8) -> list[tuple[int, int, int, bool]]:
    """(begin, end, width, whether it is the last) of at most parts pieces of a histogram, latest first, each of whole buckets."""
    width = bucket_width(lo, hi, target)
    first = lo // width * width
    n = max(0, -(-(hi - first) // width))
    step = max(1, -(-n // parts))
    starts = list(range(0, n, step))[::-1] or [0]
    return [(first + k * width, min(hi, first + (k + step) * width), width, k == 0) for k in starts]


def row_by_id(df: DataFrame, row: str, layout: Layout = Layout(), slack_ms: int = 3_600_000) -> DataFrame:
    """The row of an id. Time-ordered ids narrow the scan to an hour around their time."""
    rows = df
    if isinstance(row, str) and len(row) == 36:
        ms = int(row.replace("-", "")[:12], 16)
        rows = rows.where(F.col(layout.time).between(ms - slack_ms, ms + slack_ms))
    return rows.where(F.col(layout.row) == row)


@dataclass
class Page:
    rows: DataFrame
    cursor: str | None
    has_more: bool
    total: int | None = None


def total(query, df: DataFrame, layout: Layout = Layout(), **how) -> DataFrame:
    """One row, total: how many rows a query has, whatever the page."""
    return plan(query, df, layout, **how).agg(F.count(F.lit(1)).alias("total"))


def page(query, df: DataFrame, size: int = 100, cursor=None, layout: Layout = Layout(), largest: int = 10_000, count: bool = False, columns: tuple[str, ...] = (), **how) -> Page:
    """One page of rows, newest first, of at most largest, and the cursor of the next. count: with the total. columns pins what later pages show to those of the first; one that a row lacks is null."""
    size = max(1, min(size, largest))
    found = plan(query, df, layout, cursor=cursor, limit=size + 1, **how)
    rows = found.limit(size)
    ids = [r[0] for r in found.select(layout.row).collect()] if layout.row in found.columns else []
    if columns:
        rows = rows.select(*[F.col(f"`{c}`") if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns])
    n = total(query, df, layout, **how).first()["total"] if count else None
    return Page(rows, ids[size - 1] if len(ids) > size else None, len(ids) > size, n)

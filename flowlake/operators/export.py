"""Rows as lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _csv_value(c: Column) -> Column:
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def lines(df: DataFrame, kind: str, header: bool = False) -> DataFrame:
    """One column, line: ndjson, json (an array), csv, tsv or ltsv. Null is null in ndjson and json, left out of ltsv, and empty in csv and tsv. header: csv and tsv begin with the columns' names, json with a bracket, and end with one."""
    names = df.columns
    flat = lambda c: F.translate(c.cast("string"), "\t\r\n", "   ")
    if kind in ("ndjson", "json"):
        line = F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]), {"ignoreNullFields": "false"})
    elif kind == "csv":
        line = F.concat_ws(",", *[_csv_value(F.col(f"`{c}`")) for c in names])
    elif kind == "tsv":
        line = F.concat_ws("\t", *[F.coalesce(flat(F.col(f"`{c}`")), F.lit("")) for c in names])
    elif kind == "ltsv":
        line = F.concat_ws("\t", *[F.concat(F.lit(f"{c}:"), flat(F.col(f"`{c}`"))) for c in names])
    else:
        raise ValueError(f"no export format {kind!r}")
    out = df.select(line.alias("line"))
    if header and kind in ("csv", "tsv"):
        first = df.sparkSession.range(1).select((F.concat_ws(",", *[_csv_value(F.lit(c)) for c in names]) if kind == "csv" else F.concat_ws("\t", *[flat(F.lit(c)) for c in names])).alias("line"))
        return first.union(out)
    return out


def write(df: DataFrame, path: str, kind: str) -> None:
    """Text files of the lines, each file with its own header (csv, tsv); json as lines, one object each."""
    if kind in ("csv", "tsv"):
        df.select(*[F.col(f"`{c}`").cast("string") for c in df.columns]).write.csv(path, header=True, sep="," if kind == "csv" else "\t", escape='"')
    else:
        lines(df, kind).write.text(path)


def json_text(df: DataFrame, limit: int = 10_000) -> str:
    """One page of rows as a JSON array; for more, write lines."""
    rows = [r["line"] for r in lines(df.limit(limit), "json").collect()]
    return "[\n" + ",\n".join("  " + r for r in rows) + "\n]\n"

"""Datagrams to flows, in batch and streams. Datagrams: exporter_ip long, exporter_port int, received_ms long, seq long, data binary."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import tables
from ..sources.wire import Session, WireError, decode

_COLUMN = {"u8": "int", "u16": "int", "u32": "long", "u64": "long", "i8": "int", "i16": "int", "i32": "int", "i64": "long", "sec": "long", "ms": "long", "ip4": "long", "ip6": "binary", "oct": "binary", "mac": "string", "str": "string", "f32": "double", "f64": "double"}
_SYSTEM = (("sysExporterIPv4", "long"), ("sysExporterPort", "int"), ("sysExportTime", "long"), ("sysObservationDomainId", "long"), ("sysFlowDuration", "long"))


def fields_of(registry: dict | None = None) -> tuple[tuple[str, str], ...]:
    """Columns of all elements that are known, with a registry those of it too. What isn't known has no column: name it in `fields` (as pen9.ie5) to keep its bytes."""
    known = {name: _COLUMN[kind] for name, kind in [*tables.ELEMENTS.values(), *(registry or {}).values()]}
    return _SYSTEM + tuple(known.items())


FIELDS = fields_of()
SCHEMA = ", ".join(f"`{n}` {t}" for n, t in FIELDS)
_TOP = {"long": (1 << 63) - 1, "int": (1 << 31) - 1}


def _frame(rows: list[dict], fields: tuple) -> pd.DataFrame:
    """Rows as columns. Counters beyond 63 bits stop there; bytes of an odd length fit binary columns only, other values their own kind."""

    def fits(v, t: str):
        if t in _TOP:
            return min(v, _TOP[t]) if isinstance(v, int) else None
        if t == "double":
            return float(v) if isinstance(v, (int, float)) else None
        return v if isinstance(v, bytes if t == "binary" else str) else None

    def column(n: str, t: str):
        values = [fits(r.get(n), t) for r in rows] if n in there else [None] * len(rows)
        return pd.array(values, dtype="Int64") if t in _TOP else pd.Series(values, dtype="float64" if t == "double" else object)

    there = set().union(*rows)
    return pd.DataFrame({n: column(n, t) for n, t in fields})


def _run(session: Session, rows) -> list[dict]:
    """Flows of the messages; one that is refused counts as lost and ends nothing else."""
    out: list[dict] = []
    for ip, port, ms, data in rows:
        try:
            out += decode(bytes(data), (ip, port), session, ms / 1000)
        except WireError:
            session.lost += 1
    return out


def decode_batch(datagrams: DataFrame, fields: tuple = FIELDS, registry: dict | None = None) -> DataFrame:
    """Flows of stored datagrams, by exporter in order of arrival, since templates precede data. Only the session is held: rows of an exporter stream through one task."""
    names = ["exporter_ip", "exporter_port", "received_ms", "data"]
    key = names[:2]
    schema = ", ".join(f"`{n}` {t}" for n, t in fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, session = None, Session(registry=registry)
        for pdf in batches:
            out: list[dict] = []
            for row in zip(*(pdf[n] for n in names), strict=True):
                if (row[0], row[1]) != now:
                    now, session = (row[0], row[1]), Session(registry=registry)
                out += _run(session, [row])
            yield _frame(out, fields)

    parts = int(datagrams.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, so that small tables are spread too: decoding is work by row
    return datagrams.repartition(parts, *key).sortWithinPartitions(*key, "received_ms", "seq").select(*names).mapInPandas(run, schema)


def interface_names(datagrams: DataFrame, registry: dict | None = None) -> DataFrame:
    """exporter long, domain long, interface long, name string: what option data says, the latest of each interface. Templates and options come first of each exporter's messages, so only the session is held."""
    names = ["exporter_ip", "exporter_port", "received_ms", "data"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, session = None, Session(registry=registry)
        for pdf in batches:
            rows: list[tuple] = []
            for row in zip(*(pdf[n] for n in names), strict=True):
                if (row[0], row[1]) != now:
                    now, session = (row[0], row[1]), Session(registry=registry)
                _run(session, [row])
                rows += [(k[0], k[2], k[3], row[2], v) for k, v in session.interfaces.items()]
                session.interfaces.clear()
            yield pd.DataFrame(rows, columns=["exporter", "domain", "interface", "at", "name"]).astype({c: "int64" for c in ("exporter", "domain", "interface", "at")})

    parts = int(datagrams.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = datagrams.repartition(parts, *names[:2]).sortWithinPartitions(*names[:2], "received_ms", "seq").select(*names).mapInPandas(run, "exporter long, domain long, interface long, at long, name string")
    return told.groupBy("exporter", "domain", "interface").agg(F.max_by("name", F.struct("at", "name")).alias("name"))


def decode_stream(datagrams: DataFrame, fields: tuple = FIELDS, registry: dict | None = None, template_age: float = 1800, spool_age: float = 300) -> DataFrame:
    """The same for a stream; templates and waiting sets are state by exporter, and age out."""
    schema = ", ".join(f"`{n}` {t}" for n, t in fields)

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        session = pickle.loads(state.get[0]) if state.exists else Session(registry=registry)
        latest = 0.0
        for pdf in frames:  # in order within each frame; a set that comes before its template waits for it
            pdf = pdf.sort_values(["received_ms", "seq"], kind="stable")
            out = _run(session, zip(pdf["exporter_ip"], pdf["exporter_port"], pdf["received_ms"], pdf["data"], strict=True))
            latest = max(latest, float(pdf["received_ms"].max()) if len(pdf) else 0.0)
            yield _frame(out, fields)
        session.expire(latest / 1000, template_age, spool_age)
        state.update((pickle.dumps(session),))
        state.setTimeoutDuration(int(template_age * 1000))

    return datagrams.groupBy("exporter_ip", "exporter_port").applyInPandasWithState(step, schema, "session binary", "append", GroupStateTimeout.ProcessingTimeTimeout)

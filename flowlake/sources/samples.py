"""Datagrams made of the flow view, to run the decoders on."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..streaming.decode import FIELDS, decode_batch, interface_names
from .flows import flows

_TEMPLATE = ((8, 4), (12, 4), (7, 2), (11, 2), (4, 1), (1, 8))
COLUMNS = ("sourceIPv4Address", "destinationIPv4Address", "sourceTransportPort", "destinationTransportPort", "protocolIdentifier", "octetDeltaCount")
_ROW = struct.Struct(">IIHHBQ")


def _set(number: int, body: bytes) -> bytes:
    return struct.pack(">HH", number, len(body) + 4) + body


def message(kind: str, rows: list[tuple], seconds: int = 1_700_000_000, template: bool = True) -> bytes:
    """One datagram of rows of COLUMNS: ipfix, netflow_v9 or netflow_v5."""
    if kind == "netflow_v5":
        body = b"".join(struct.pack(">IIIHHIIIIHHBBBBHHBBH", s, d, 0, 1, 2, 1, o, 10, 20, sp, dp, 0, 0, p, 0, 0, 0, 0, 0, 0) for s, d, sp, dp, p, o in rows)
        return struct.pack(">HHIIIIBBH", 5, len(rows), 1000, seconds, 0, 0, 1, 2, 0) + body
    fields = struct.pack(">HH", 256, len(_TEMPLATE)) + b"".join(struct.pack(">HH", *f) for f in _TEMPLATE)
    sets = (_set(2 if kind == "ipfix" else 0, fields) if template else b"") + _set(256, b"".join(_ROW.pack(*r) for r in rows))
    if kind == "ipfix":
        return struct.pack(">HHIII", 10, 16 + len(sets), seconds, 1, 1) + sets
    return struct.pack(">HHIIII", 9, 2, 1000, seconds, 1, 1) + sets


def datagrams(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """All flows in datagrams of 20, dealt by a checksum over 16,384 exporters (1024 addresses, 16 ports)."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = list(pdf[list(COLUMNS)].itertuples(index=False, name=None))
            cut = [rows[i : i + 20] for i in range(0, len(rows), 20)]
            n, data = len(cut), [message(kind, c) for c in cut]
            sums = [zlib.crc32(d) for d in data]
            yield pd.DataFrame({"exporter_ip": [167772161 + x % 1024 for x in sums], "exporter_port": [4739 + (x >> 10) % 16 for x in sums], "received_ms": [1_700_000_000_000] * n, "seq": range(n), "data": data})

    return flows(spark, sf_dir).select(*COLUMNS).mapInPandas(pack, "exporter_ip long, exporter_port int, received_ms long, seq long, data binary")


def decoded(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    fields = tuple(f for f in FIELDS if f[0] in COLUMNS)
    return decode_batch(datagrams(spark, sf_dir, kind), fields).select(*[F.col(c).cast("long").alias(c) if c != "protocolIdentifier" else F.col(c) for c in COLUMNS])


def interfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names told in options by 16 exporters: one option message an interface number, after its exporter's template."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i in pdf["i"]:
                ip, name = 167772161 + i % 16, f"port{i}".encode()
                template = _set(3, struct.pack(">HHHHHHH", 257, 2, 1, 10, 4, 82, 65535))
                body = template + _set(257, struct.pack(">IB", i, len(name)) + name)
                rows.append((ip, 4739, 1_700_000_000_000, i, struct.pack(">HHIII", 10, 16 + len(body), 1_700_000_000, 1, 1) + body))
            yield pd.DataFrame(rows, columns=["exporter_ip", "exporter_port", "received_ms", "seq", "data"])

    numbers = flows(spark, sf_dir).select((F.col("sysRowId") % 1024).alias("i")).distinct()
    return interface_names(numbers.mapInPandas(pack, "exporter_ip long, exporter_port int, received_ms long, seq long, data binary"))

"""What can be asked of a table: its fields, the tests that fit them, completions, interface names."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import tables
from ..plans.ast import Item, Select
from ..plans.fql import FUNCTIONS
from ..plans.literals import PORTS, PROTOCOLS
from .filters import Fields

# Words of the query language, the tests that fit a kind of field, what tests mean.
KEYWORDS = ("last", "offset", "at", "daily", "weekly", "every", "select", "except", "as", "group by", "top", "bottom", "by", "sort", "asc", "desc", "limit", "and", "or", "not", "in")
TESTS = {
    "ip4": ("eq", "ne", "in", "not_in", "cidr", "wildcard", "ip_range"), "bytes": ("eq", "ne", "in", "not_in", "cidr"), "mac": ("eq", "ne", "in", "not_in", "prefix", "contains"),
    "text": ("eq", "ne", "in", "not_in", "regex", "not_regex", "contains", "not_contains", "starts_with", "ends_with"), "flag": ("eq", "ne"),
    "port": ("eq", "ne", "gt", "ge", "lt", "le", "between", "port_range", "in", "not_in", "named"), "proto": ("eq", "ne", "in", "not_in", "named"), "number": ("eq", "ne", "gt", "ge", "lt", "le", "between", "in", "not_in"),
}

FILTER_TYPES = {"ipv4": TESTS["ip4"], "ipv6": TESTS["bytes"], "port": TESTS["port"], "protocol": TESTS["proto"], "numeric": TESTS["number"], "string": TESTS["text"], "mac": TESTS["mac"], "boolean": TESTS["flag"]}
OP_HINTS = {
    "eq": "Exact match", "ne": "Not equal", "gt": "Greater than", "ge": "Greater or equal", "lt": "Less than", "le": "Less or equal", "in": "Match any in list", "not_in": "Match none in list",
    "between": "Within range (min-max)", "cidr": "Subnet match (e.g. /24)", "wildcard": "Wildcard pattern (e.g. 10.*.*.1)", "ip_range": "IP range (e.g. .1-.255)", "regex": "Regular expression", "not_regex": "Not matching regex",
    "contains": "Contains substring", "not_contains": "Does not contain", "starts_with": "Starts with prefix", "ends_with": "Ends with suffix", "port_range": "Port range (e.g. 1024-65535)", "named": "Well-known name", "prefix": "MAC vendor prefix",
}
# What a field's values are, by a pattern of its name; the first that fits counts.
SEMANTICS = (
    ("(?i).*duration", "duration_ms"), ("tcpControlBits$", "tcp_flags"), ("icmpTypeCode", "icmp_type"), ("ipClassOfService$", "dscp"), (".*AsNumber", "asn"), ("(in|e)gress.*Interface", "interface"),
    ("(octet|packet)DeltaCount$", "counter"), (".*Seconds$", "timestamp_s"), (".*(Milli|Micro|Nano)seconds$|sysExportTime$", "timestamp_ms"),
)
#: Columns that are shown at first, in this order, and those that a narrow table adds.
DEFAULT_COLUMNS = ("sysExportTime", "sourceIPv4Address", "sourceTransportPort", "destinationIPv4Address", "destinationTransportPort", "protocolIdentifier", "octetDeltaCount", "flowDurationMilliseconds", "tcpControlBits")
KEY_COLUMNS = (*DEFAULT_COLUMNS, "sourceIPv6Address", "destinationIPv6Address", "packetDeltaCount", "sysFlowDuration")
# Types of the columns that a decoder adds; times are in ms, which 32 bits don't hold.
_SYSTEM_TYPES = {"sysExporterIPv4": "ipv4", "sysExporterPort": "uint16", "sysExportTime": "uint64", "sysObservationDomainId": "uint32", "time_bucket": "uint64"}
#: The name of a row's id where it was asked for only to continue a page.
ROW_MARK = "__row"


def result_type(name: str) -> str:
    """The type of a result's column by its name: that of a system column or element, number for aggregates, or unknown."""
    if "(" in name:
        return "number"
    return _SYSTEM_TYPES.get(name) or tables.abstract_type(name) or "unknown"


def visible_columns(columns: list[str]) -> list[str]:
    """What a narrow table shows: the key columns that are there, or all, of aggregates and where fewer than three are."""
    found = [c for c in KEY_COLUMNS if c in columns]
    return list(columns) if len(found) < 3 or any("(" in c for c in columns) else found


def with_row(select: Select, row: str) -> Select:
    """select, with the row's id beside what it shows."""
    if select.star:
        return Select(star=True, without=tuple(w for w in select.without if w.lower() != row.lower()))
    return Select((*select.items, Item(row, alias=ROW_MARK)))


def elements(spark: SparkSession, registry: dict | None = None) -> DataFrame:
    """enterprise int, id int, name, type of the information elements that decoders know, those of a registry too."""
    known = {(0, n): e for n, e in tables.ELEMENTS.items()} | (registry or {})
    return spark.createDataFrame([(*k, name, tables.abstract_type(name, kind)) for k, (name, kind) in sorted(known.items())], "enterprise int, id int, name string, type string")


def schema_fields(df: DataFrame) -> list[dict]:
    """name, filter_type, data_type, semantic_hint and alias_of of each column, and of each alias that stands for one."""
    fields, out = Fields(df), []

    def kind(name: str) -> str:
        if "port" == name or name.endswith("TransportPort"):
            return "port"
        if name == "protocolIdentifier":
            return "protocol"
        return {"ip4": "ipv4", "bytes": "ipv6" if "IPv6" in name else "string", "text": "string", "flag": "boolean", "number": "numeric"}.get(fields.kind(name), fields.kind(name))

    names = [(c, c) for c in sorted(df.columns)] + [(a, c) for a, c in tables.ALIASES.items() if c in df.columns]
    for shown, name in names:
        hint = next((h for p, h in SEMANTICS if re.match(p, name)), "")
        out.append({"name": shown, "filter_type": kind(name), "data_type": result_type(name), "semantic_hint": hint, "alias_of": name if shown != name else None})
    return out


def type_name(name: str, kind: str) -> str:
    """The result type of a column: ipv4, ipv6, mac, string, boolean or a number type."""
    if "IPv4" in name and kind in ("bigint", "int"):
        return "ipv4"
    if kind == "binary":
        return "ipv6" if "IPv6" in name else "bytes"
    if "MacAddress" in name:
        return "mac"
    return {"tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "double": "float64", "float": "float32"}.get(kind, kind)


def describe(df: DataFrame) -> list[dict]:
    """name, type, aliases and tests of each column, by name."""
    fields = Fields(df)
    out = []
    for name, kind in sorted(df.dtypes):
        role = "port" if name.endswith("TransportPort") else "proto" if name == "protocolIdentifier" else fields.kind(name)
        out.append({"name": name, "type": type_name(name, kind), "aliases": sorted(a for a, n in tables.ALIASES.items() if n == name), "tests": list(TESTS[role])})
    return out


def complete(prefix: str, df: DataFrame | None = None) -> list[tuple[str, str]]:
    """(word, what it is) of the words that begin with prefix, in any case."""
    low = prefix.lower()
    known = [(w, "keyword") for w in KEYWORDS] + [(f"{w}()", "function") for w in FUNCTIONS] + [(w, "alias") for w in tables.ALIASES] + [(w, "port") for w in PORTS] + [(w, "protocol") for w in PROTOCOLS]
    known += [(c, "field") for c in (df.columns if df is not None else [n for n, _ in tables.ELEMENTS.values()])]
    return sorted({(w, k) for w, k in known if w.lower().startswith(low)})


def with_interface_names(flows: DataFrame, names: DataFrame, limit: int = 100_000) -> DataFrame:
    """flows with ingressName and egressName from names (exporter long, domain long, interface long, name string); without one, the number."""
    if names.limit(limit + 1).count() <= limit:
        names = F.broadcast(names)
    for column, out in (("ingressInterface", "ingressName"), ("egressInterface", "egressName")):
        own = names.select(F.col("exporter").alias("sysExporterIPv4"), F.col("domain").alias("sysObservationDomainId"), F.col("interface").alias(column), F.col("name").alias(out))
        flows = flows.join(own, ["sysExporterIPv4", "sysObservationDomainId", column], "left").withColumn(out, F.coalesce(out, F.col(column).cast("string")))
    return flows

"""Registered queries over the flow view, each with the same question as DuckDB SQL where SQL can ask it."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .functions import exprs, tables
from .operators import catalog, export, histogram as hist
from .operators.planner import plan
from .operators.service import Service
from .plans.fql import parse
from .plans.structured import from_json
from .sources import samples
from .sources.flows import FLOWS_DUCKDB, STORED_LAYOUT, flows, read_flows
from .streaming import sink

_LO, _HI = 1704067200000, 1706745600000
_ALL = "2024-01-01..2024-02-01"
_NOW = 1706000000000
_IDS = "select sysRowId, sysExportTime"


def _plain(df: DataFrame) -> DataFrame:
    return df.toDF(*[re.sub(r"\W+", "_", c).strip("_") for c in df.columns])


def _sql(body: str) -> str:
    return f"WITH flows AS ({FLOWS_DUCKDB}) {body}"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, query: str | dict, sql: str, **how) -> None:
    asked = parse(query) if isinstance(query, str) else from_json(query)
    QUERIES[name] = lambda spark, d: _plain(plan(asked, flows(spark, d), now_ms=_NOW, **how))
    SQL[name] = _sql(sql)


def _rows(name: str, text: str, where: str) -> None:
    _add(name, f"{_ALL} | {text} | {_IDS}", f"SELECT sysRowId, sysExportTime FROM flows WHERE sysExportTime BETWEEN {_LO} AND {_HI} AND ({where})")


def _timed(name: str, time: str, where: str) -> None:
    _add(name, f"{time} | {_IDS}", f"SELECT sysRowId, sysExportTime FROM flows WHERE {where}")


def _json(name: str, field: str, op: str, value, where: str) -> None:
    _add(name, {"time_range": {"type": "absolute", "start": "2024-01-01", "end": "2024-02-01"}, "filters": [{"field": field, "op": op, "value": value}], "columns": ["sysRowId", "sysExportTime"]}, f"SELECT sysRowId, sysExportTime FROM flows WHERE sysExportTime BETWEEN {_LO} AND {_HI} AND ({where})")


_DAY = 86_400_000
_timed("time_absolute", "2024-01-05T08:00..2024-01-06T17:30", "sysExportTime BETWEEN 1704441600000 AND 1704562200000")
_timed("time_relative", "last 2d12h", f"sysExportTime BETWEEN {_NOW - 216_000_000} AND {_NOW}")
_timed("time_offset", "last 1d offset 1w", f"sysExportTime BETWEEN {_NOW - 8 * _DAY} AND {_NOW - 7 * _DAY}")
_timed("time_single_day", "2024-01-10", f"sysExportTime BETWEEN 1704844800000 AND {1704844800000 + _DAY - 1}")
_timed("time_point", "at 2024-01-10T12:00 +-2h", "sysExportTime BETWEEN 1704880800000 AND 1704895200000")
_timed("time_daily", "last 30d daily 09:00..10:00", f"sysExportTime BETWEEN {_NOW - 30 * _DAY} AND {_NOW} AND sysExportTime % {_DAY} >= 32400000 AND sysExportTime % {_DAY} < 36000000")
_timed("time_weekly", "last 30d weekly mon 08:00..17:00", f"sysExportTime BETWEEN {_NOW - 30 * _DAY} AND {_NOW} AND sysExportTime % {_DAY} >= 28800000 AND sysExportTime % {_DAY} < 61200000 AND (sysExportTime // {_DAY} + 3) % 7 = 0")
_timed("time_combined", "(2024-01-05, 2024-01-10T00:00..2024-01-10T06:00)", "sysExportTime BETWEEN 1704412800000 AND 1704499199999 OR sysExportTime BETWEEN 1704844800000 AND 1704866400000")

_rows("filter_and_or_not", "proto tcp and not (dport 80 or dport 443)", "protocolIdentifier = 6 AND NOT (destinationTransportPort = 80 OR destinationTransportPort = 443)")
_rows("ip_eq", "src 10.0.30.239", "sourceIPv4Address = 167780079")
_rows("ip_any", "ip 192.168.0.5", "sourceIPv4Address = 3232235525 OR destinationIPv4Address = 3232235525")
_rows("ip_any_negated", "ip not 192.168.0.5", "sourceIPv4Address <> 3232235525 OR destinationIPv4Address <> 3232235525")
_rows("ip_not_any", "not ip 192.168.0.5", "sourceIPv4Address <> 3232235525 AND destinationIPv4Address <> 3232235525")
_rows("ip_cidr", "dst 192.168.2.0/24", "destinationIPv4Address & 4294967040 = 3232236032")
_rows("ip_cidr_zero", "src 0.0.0.0/0", "true")
_rows("ip_list", "dst in (192.168.0.1, 192.168.1.1)", "destinationIPv4Address IN (3232235521, 3232235777)")
_rows("ip_list_cidr", "dst in (192.168.0.1, 192.168.1.0/28)", "destinationIPv4Address = 3232235521 OR destinationIPv4Address BETWEEN 3232235776 AND 3232235791")
_rows("ip_wildcard", "dst 192.168.*.7", "destinationIPv4Address >> 16 = 49320 AND destinationIPv4Address & 255 = 7")
_json("ip_range", "dst", "ip_range", "192.168.0.10-192.168.0.20", "destinationIPv4Address BETWEEN 3232235530 AND 3232235540")
_rows("port_single", "dport 443", "destinationTransportPort = 443")
_rows("port_range", "sport 2000-3000", "sourceTransportPort BETWEEN 2000 AND 3000")
_rows("port_open", "sport 9000-", "sourceTransportPort >= 9000 AND sourceTransportPort <= 65535")
_rows("port_list", "dport 22,80-90", "destinationTransportPort = 22 OR destinationTransportPort BETWEEN 80 AND 90")
_rows("port_named", "dport dns", "destinationTransportPort = 53")
_rows("port_any", "port 1100", "sourceTransportPort = 1100 OR destinationTransportPort = 1100")
_rows("proto_named", "proto udp", "protocolIdentifier = 17")
_rows("proto_list", "proto tcp,udp", "protocolIdentifier IN (6, 17)")
_rows("num_cmp", "packets >= 60", "packetDeltaCount >= 60")
_rows("num_suffix", "bytes > 20k", "octetDeltaCount > 20000")
_json("num_between", "bytes", "between", [1000, 5000], "octetDeltaCount BETWEEN 1000 AND 5000")
_rows("num_in", "packets in (1, 2, 3)", "packetDeltaCount IN (1, 2, 3)")
_rows("str_eq", 'app = "click"', "applicationName = 'click'")
_rows("str_in", 'app in ("click", "view")', "applicationName IN ('click', 'view')")
_rows("str_regex", 'app ~ "^(cl|si)"', "regexp_matches(applicationName, '^(cl|si)')")
_rows("str_not_regex", 'app !~ "^(cl|si)"', "NOT regexp_matches(applicationName, '^(cl|si)')")
_json("str_contains", "app", "contains", "ic", "contains(applicationName, 'ic')")
_json("str_starts", "app", "starts_with", "er", "starts_with(applicationName, 'er')")
_json("str_ends", "app", "ends_with", "up", "ends_with(applicationName, 'up')")
_rows("mac_eq", 'srcmac = "00:00:00-64.00:64"', "sourceMacAddress = '000000640064'")
_json("mac_prefix", "srcmac", "prefix", "00:00:00:1", "starts_with(sourceMacAddress, '0000001')")
_rows("missing_column_false", "vlan = 5 or dport 22", "destinationTransportPort = 22")
_rows("missing_column_not_true", "not vlan = 5 and dport 22", "destinationTransportPort = 22")

_W = f"FROM flows WHERE sysExportTime BETWEEN {_LO} AND {_HI}"
_add("select_fields", f"{_ALL} | select src, dst, bytes, sysRowId", f"SELECT sourceIPv4Address, destinationIPv4Address, octetDeltaCount, sysRowId {_W}")
_add("select_all", f"{_ALL} | dport 22", f"SELECT * {_W} AND destinationTransportPort = 22")
_add("select_except", f"{_ALL} | dport 22 | select * except (src, srcmac)", f"SELECT * EXCLUDE (sourceIPv4Address, sourceMacAddress) {_W} AND destinationTransportPort = 22")
_add("select_alias", f"{_ALL} | select bytes as b, sysRowId as id", f"SELECT octetDeltaCount AS b, sysRowId AS id {_W}")
for _n, _op, _e in (("div", "/", "octetDeltaCount::DOUBLE / packetDeltaCount"), ("mul", "*", "octetDeltaCount::DOUBLE * packetDeltaCount"), ("add", "+", "octetDeltaCount::DOUBLE + packetDeltaCount"), ("sub", "-", "octetDeltaCount::DOUBLE - packetDeltaCount")):
    _add(f"select_{_n}", f"{_ALL} | select sysRowId, bytes {_op} packets as x", f"SELECT sysRowId, {_e} AS x {_W}")

_IP = "concat_ws('.', {0} >> 24, ({0} >> 16) & 255, ({0} >> 8) & 255, {0} & 255)"


def _group(name: str, keys: str, aggs: str, sql: str, tail: str = "") -> None:
    _add(name, f"{_ALL} | group by {keys}" + (f" | {aggs}" if aggs else "") + tail, sql)


_group("group_field", "dport", "sum(bytes), count()", f"SELECT destinationTransportPort, CAST(sum(octetDeltaCount) AS BIGINT) AS sum_bytes, count(*) AS count {_W} GROUP BY 1")
_group("group_multi", "app, proto", "sum(packets)", f"SELECT applicationName, protocolIdentifier, CAST(sum(packetDeltaCount) AS BIGINT) AS sum_packets {_W} GROUP BY 1, 2")
_group("group_distinct", "app, dport", "", f"SELECT DISTINCT applicationName, destinationTransportPort {_W}")
for _p, _m in ((16, 4294901760), (24, 4294967040)):
    _group(f"group_subnet{_p}", f"src /{_p}", "sum(bytes)", f"SELECT {_IP.format(f'(sourceIPv4Address & {_m})')} || '/{_p}' AS sourceIPv4Address_{_p}, CAST(sum(octetDeltaCount) AS BIGINT) AS sum_bytes {_W} GROUP BY 1")
_group("group_bucket_5m", "5m", "count()", f"SELECT sysExportTime // 300000 * 300000 AS time_bucket, count(*) AS count {_W} GROUP BY 1")
_group("group_bucket_1d", "1d", "sum(bytes)", f"SELECT sysExportTime // {_DAY} * {_DAY} AS time_bucket, CAST(sum(octetDeltaCount) AS BIGINT) AS sum_bytes {_W} GROUP BY 1")
_group("group_bucket_field", "1d, app", "sum(bytes)", f"SELECT sysExportTime // {_DAY} * {_DAY} AS time_bucket, applicationName, CAST(sum(octetDeltaCount) AS BIGINT) AS sum_bytes {_W} GROUP BY 1, 2")
_RATE = (_HI - _LO) / 1000
for _f, _e in {
    "sum": "CAST(sum(octetDeltaCount) AS BIGINT)", "avg": "avg(octetDeltaCount)", "min": "min(octetDeltaCount)", "max": "max(octetDeltaCount)", "uniq": "count(DISTINCT octetDeltaCount)",
    "p50": "quantile_cont(octetDeltaCount, 0.5)", "p95": "quantile_cont(octetDeltaCount, 0.95)", "p99": "quantile_cont(octetDeltaCount, 0.99)", "stddev": "stddev_samp(octetDeltaCount)",
    "rate": f"CAST(sum(octetDeltaCount) AS BIGINT) / {_RATE}::DOUBLE", "first": "arg_min(octetDeltaCount, (sysExportTime, sysRowId))", "last": "arg_max(octetDeltaCount, (sysExportTime, sysRowId))",
}.items():
    _group(f"agg_{_f}", "app", f"{_f}(bytes)", f"SELECT applicationName, {_e} AS {_f}_bytes {_W} GROUP BY 1")
_add("agg_p95_sketch", f"{_ALL} | group by app | p95(packets)", f"SELECT applicationName, quantile_disc(packetDeltaCount, 0.95) AS p95_packets {_W} GROUP BY 1", approximate=True)
_add("row_guard", f"{_ALL} | dport 22 | group by src | count()", f"SELECT sourceIPv4Address, count(*) AS count {_W} AND destinationTransportPort = 22 GROUP BY 1", row_guard=10**12)
_group("agg_count", "app", "count()", f"SELECT applicationName, count(*) AS count {_W} GROUP BY 1")
_group("group_limit", "src", "sum(bytes)", f"SELECT sourceIPv4Address, CAST(sum(octetDeltaCount) AS BIGINT) AS sum_bytes {_W} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 7", " | limit 7")
_group("top_groups", "src", "count()", f"SELECT sourceIPv4Address, n AS count FROM (SELECT sourceIPv4Address, count(*) AS n, sum(octetDeltaCount) AS s {_W} GROUP BY 1) ORDER BY s DESC, 1 LIMIT 5", " | top 5 by sum(bytes)")
_NEW = "sysExportTime DESC, sysRowId DESC"
_add("top_n", f"{_ALL} | top 10 by sum(bytes) | select sysRowId, bytes", f"SELECT sysRowId, octetDeltaCount {_W} ORDER BY octetDeltaCount DESC, {_NEW} LIMIT 10")
_add("bottom_n", f"{_ALL} | bottom 10 by sum(bytes) | select sysRowId, bytes", f"SELECT sysRowId, octetDeltaCount {_W} ORDER BY octetDeltaCount, {_NEW} LIMIT 10")
_add("top_n_count", f"{_ALL} | top 10 by count() | select sysRowId", f"SELECT sysRowId {_W} ORDER BY {_NEW} LIMIT 10")
_add("sort_asc", f"{_ALL} | sort sum(packets) | limit 50 | select sysRowId, packets", f"SELECT sysRowId, packetDeltaCount {_W} ORDER BY packetDeltaCount, {_NEW} LIMIT 50")
_add("sort_desc", f"{_ALL} | sort sum(packets) desc | select sysRowId, packets", f"SELECT sysRowId, packetDeltaCount {_W} ORDER BY packetDeltaCount DESC, {_NEW} LIMIT 10000", sort_cap=10_000)
_add("sort_all", f"{_ALL} | sort sum(packets) desc | select sysRowId, packets", f"SELECT sysRowId, packetDeltaCount {_W}")
_add("limit_default_order", f"{_ALL} | limit 25 | {_IDS}", f"SELECT sysRowId, sysExportTime {_W} ORDER BY {_NEW} LIMIT 25")
_add("page_offset", f"{_ALL} | {_IDS}", f"SELECT sysRowId, sysExportTime {_W} ORDER BY {_NEW} LIMIT 100 OFFSET 200", limit=100, offset=200)
_add("page_cursor", f"{_ALL} | {_IDS}", f"SELECT sysRowId, sysExportTime {_W} AND sysRowId < 5000 ORDER BY {_NEW} LIMIT 100", limit=100, cursor=5000)
_add("pinned_bounds", f"last 1h | {_IDS}", f"SELECT sysRowId, sysExportTime FROM flows WHERE sysExportTime BETWEEN {_LO} AND {_LO + _DAY}", bounds=(_LO, _LO + _DAY))
_add("json_group_by", {"time_range": {"type": "absolute", "start": "2024-01-01", "end": "2024-02-01"}, "filters": [{"field": "proto", "op": "eq", "value": "tcp"}], "aggregate": {"type": "group_by", "keys": ["dport"], "functions": [{"function": "sum", "field": "bytes"}]}}, f"SELECT destinationTransportPort, CAST(sum(octetDeltaCount) AS BIGINT) AS sum_bytes {_W} AND protocolIdentifier = 6 GROUP BY 1")

QUERIES["row_by_id"] = lambda spark, d: hist.row_by_id(flows(spark, d), 4242)
SQL["row_by_id"] = _sql("SELECT * FROM flows WHERE sysRowId = 4242")


def _hist_sql(where: str, lo: int = _LO, hi: int = _HI) -> str:
    w = hist.bucket_width(lo, hi)
    return _sql(f"SELECT b AS bucket, count(sysRowId) AS count FROM (SELECT unnest(range({lo // w * w}, {hi}, {w})) AS b) LEFT JOIN (SELECT * FROM flows WHERE {where}) ON sysExportTime // {w} * {w} = b GROUP BY 1")


QUERIES["histogram"] = lambda spark, d: hist.histogram(flows(spark, d), _LO, _HI)
SQL["histogram"] = _hist_sql("true")
QUERIES["histogram_filtered"] = lambda spark, d: hist.histogram(flows(spark, d), _LO, _HI, where=parse("last 1h | dport 22").stages[0])
SQL["histogram_filtered"] = _hist_sql("destinationTransportPort = 22")
QUERIES["hist_zero_fill"] = lambda spark, d: hist.histogram(flows(spark, d), _LO - 5 * _DAY, _LO + 2 * _DAY)
SQL["hist_zero_fill"] = _hist_sql("true", _LO - 5 * _DAY, _LO + 2 * _DAY)


def _progressive(spark: SparkSession, d: str) -> DataFrame:
    pieces = [hist.histogram(flows(spark, d), lo, hi, width=w) for lo, hi, w, _ in hist.progressive(_LO, _HI, parts=4)]
    return reduce(DataFrame.union, pieces)


QUERIES["histogram_progressive"] = _progressive
SQL["histogram_progressive"] = _hist_sql("true")
QUERIES["columns_compact"] = lambda spark, d: (lambda df: df.select("sysRowId", *catalog.visible_columns(df.columns)))(flows(spark, d))
SQL["columns_compact"] = _sql("SELECT sysRowId, sysExportTime, sourceIPv4Address, sourceTransportPort, destinationIPv4Address, destinationTransportPort, protocolIdentifier, octetDeltaCount, flowDurationMilliseconds, tcpControlBits, packetDeltaCount FROM flows")
QUERIES["element_registry"] = lambda spark, d: catalog.elements(spark).withColumn("n_chars", F.length("name"))
QUERIES["result_types"] = lambda spark, d: spark.createDataFrame([(c, catalog.result_type(c)) for c in flows(spark, d).columns], "name string, type string")
_KNOWN = {"applicationName": "string", "destinationIPv4Address": "ipv4address", "destinationTransportPort": "unsigned16", "flowDurationMilliseconds": "unsigned32", "octetDeltaCount": "unsigned64", "packetDeltaCount": "unsigned64", "protocolIdentifier": "unsigned8", "sourceIPv4Address": "ipv4address", "sourceMacAddress": "macaddress", "sourceTransportPort": "unsigned16", "sysExportTime": "uint64", "sysRowId": "unknown", "tcpControlBits": "unsigned16"}
SQL["result_types"] = _sql("SELECT column_name AS name, " + "CASE column_name " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KNOWN.items()) + " END AS type FROM (DESCRIBE FROM flows)")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """The third page of a query, by cursors, with the columns pinned that the first page had and one that is gone."""
    service, asked = Service(lambda: flows(spark, d)), {"query": f"{_ALL} | dport 22 | select bytes, sysRowId", "limit": 10}
    for _ in range(2):
        asked |= {"cursor": service.query(asked)["next_cursor"], "schema_columns": ["octetDeltaCount", "sysRowId", "vlanId"]}
    return spark.createDataFrame([tuple(r) for r in service.query(asked)["rows"]], "octetDeltaCount long, sysRowId long, vlanId int")


QUERIES["page_pinned_columns"] = _pages
SQL["page_pinned_columns"] = _sql(f"SELECT octetDeltaCount, sysRowId, CAST(NULL AS INTEGER) AS vlanId {_W} AND destinationTransportPort = 22 ORDER BY {_NEW} LIMIT 10 OFFSET 20")


def _derived(name: str, column: Callable[[], Column], sql: str) -> None:
    QUERIES[name] = lambda spark, d: flows(spark, d).select("sysRowId", column().alias("x"))
    SQL[name] = _sql(f"SELECT sysRowId, {sql} AS x FROM flows")


_c = F.col
_derived("derived_bps", lambda: exprs.bits_per_second(_c("octetDeltaCount"), _c("flowDurationMilliseconds")), "CASE WHEN flowDurationMilliseconds <> 0 THEN octetDeltaCount * 8000.0::DOUBLE / flowDurationMilliseconds END")
_derived("derived_pps", lambda: exprs.packets_per_second(_c("packetDeltaCount"), _c("flowDurationMilliseconds")), "CASE WHEN flowDurationMilliseconds <> 0 THEN packetDeltaCount * 1000.0::DOUBLE / flowDurationMilliseconds END")
_derived("derived_avg_pkt", lambda: exprs.average_packet(_c("octetDeltaCount"), _c("packetDeltaCount")), "octetDeltaCount::DOUBLE / packetDeltaCount")
_derived("derived_duration", lambda: exprs.flow_duration(_c("sysExportTime"), _c("sysExportTime") + _c("flowDurationMilliseconds") - 100), "greatest(flowDurationMilliseconds - 100, 0)")
_derived("fmt_ipv4", lambda: exprs.dotted(_c("sourceIPv4Address")), _IP.format("sourceIPv4Address"))
_derived("fmt_mac", lambda: exprs.format_mac(_c("sourceMacAddress")), "rtrim(regexp_replace(sourceMacAddress, '(..)', '\\1:', 'g'), ':')")
_FLAGS = ("FIN", "SYN", "RST", "PSH", "ACK", "URG", "ECE", "CWR")
_derived("fmt_tcp_flags", lambda: exprs.tcp_flags(_c("tcpControlBits")), "CASE WHEN tcpControlBits = 0 THEN '0x000' ELSE array_to_string(list_filter([" + ", ".join(f"CASE WHEN tcpControlBits & {1 << i} <> 0 THEN '{n}' END" for i, n in enumerate(_FLAGS)) + "], lambda x: x IS NOT NULL), ',') END")


def _case(value: str, names: dict[int, str], other: str) -> str:
    return f"CASE {value} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in names.items()) + f" ELSE {other} END"


_ICMP = _case("(sysRowId % 4096) >> 8", tables.ICMP_TYPES, "NULL")
_TYPE_CODE = "((sysRowId % 4096) >> 8) || '/' || (sysRowId % 256)"
_derived("fmt_icmp", lambda: exprs.icmp_type_code(_c("sysRowId") % 4096), f"coalesce({_ICMP} || ' (' || {_TYPE_CODE} || ')', {_TYPE_CODE})")
_derived("fmt_protocol", lambda: exprs.protocol_name(_c("sysRowId") % 256), _case("sysRowId % 256", tables.PROTOCOL_NAMES, "CAST(sysRowId % 256 AS VARCHAR)"))
_derived("fmt_port", lambda: exprs.port_name(_c("sysRowId") % 30000), _case("sysRowId % 30000", tables.PORT_NAMES, "CAST(sysRowId % 30000 AS VARCHAR)"))
_DSCP = _case("(sysRowId % 256) >> 2", tables.DSCP_NAMES, "NULL")
_derived("fmt_tos", lambda: exprs.service_class(_c("sysRowId") % 256), f"coalesce({_DSCP} || ' (' || (sysRowId % 256) || ')', CAST(sysRowId % 256 AS VARCHAR))")
_derived("fmt_forwarding", lambda: exprs.forwarding_status(_c("sysRowId") % 256), _case("(sysRowId % 256) & 3", tables.FORWARDING, "''"))
for _e in tables.ENUMERATIONS:
    _derived(f"fmt_enum_{_e}", lambda e=_e: exprs.enum_name(_c("sysRowId") % 12, e), _case("sysRowId % 12", tables.ENUMERATIONS[_e], "CAST(sysRowId % 12 AS VARCHAR)"))


def _units(x: str, steps: tuple, least: str) -> str:
    """A value over the first unit that it reaches, in SQL; ties go up."""
    return "CASE " + " ".join(f"WHEN {x} >= {size} THEN printf('%.{digits}f', round({x} / {size}::DOUBLE + 1e-9, {digits})) || '{name}'" for size, digits, name in steps) + f" ELSE {least} END"


_BIG = "(octetDeltaCount * CAST(pow(10, sysRowId % 9) AS BIGINT))"  # up to 5 * 10**12
_big = lambda: _c("octetDeltaCount") * F.pow(F.lit(10.0), _c("sysRowId") % 9).cast("long")
_derived("fmt_bytes", lambda: exprs.format_bytes(_big()), _units(_BIG, ((1 << 40, 2, " TB"), (1 << 30, 2, " GB"), (1 << 20, 1, " MB"), (1 << 10, 1, " KB")), f"{_BIG} || ' B'"))
_derived("fmt_number", lambda: exprs.format_number(_big()), f"format('{{:,}}', {_BIG})")
_derived("fmt_packets", lambda: exprs.format_packets(_big()), _units(_BIG, ((10**9, 2, "G"), (10**6, 1, "M"), (10**4, 1, "K")), f"format('{{:,}}', {_BIG})"))
_derived("fmt_bps", lambda: exprs.format_bps(_big()), _units(_BIG, ((10**12, 2, " Tbps"), (10**9, 2, " Gbps"), (10**6, 1, " Mbps"), (10**3, 1, " Kbps")), f"{_BIG} || ' bps'"))
_derived("fmt_pps", lambda: exprs.format_pps(_big()), _units(_BIG, ((10**9, 2, " Gpps"), (10**6, 1, " Mpps"), (10**3, 1, " Kpps")), f"{_BIG} || ' pps'"))


def _spans_sql(s: str, rest: str) -> str:
    parts = [f"CASE WHEN {v} > 0 THEN ({v}) || '{u}' END" for v, u in ((f"{s} // 86400", "d"), (f"{s} // 3600 % 24", "h"), (f"{s} // 60 % 60", "m"))]
    return f"concat_ws(' ', {', '.join(parts)}, {rest})"


_MS = "(sysRowId * 977)"
_derived("fmt_duration", lambda: exprs.format_duration(_c("sysRowId") * 977), _spans_sql(f"({_MS} // 1000)", f"CASE WHEN {_MS} < 60000 AND {_MS} % 1000 > 0 THEN printf('%.1f', round({_MS} / 1000.0::DOUBLE, 1)) || 's' WHEN {_MS} // 1000 % 60 > 0 OR {_MS} < 60000 THEN ({_MS} // 1000 % 60) || 's' END"))
_derived("fmt_uptime", lambda: exprs.format_uptime(_c("sysRowId") * 977), _spans_sql(_MS, f"CASE WHEN {_MS} % 60 > 0 OR {_MS} = 0 THEN ({_MS} % 60) || 's' END"))
_AGE = f"({_HI} - sysExportTime)"
_derived("fmt_relative", lambda: exprs.relative_time(_c("sysExportTime"), _HI), f"CASE WHEN {_AGE} < 0 THEN 'in the future' WHEN {_AGE} < 5000 THEN 'just now' WHEN {_AGE} < 60000 THEN ({_AGE} // 1000) || 's ago' WHEN {_AGE} < 3600000 THEN ({_AGE} // 60000) || 'm ago' WHEN {_AGE} < {_DAY} THEN ({_AGE} // 3600000) || 'h ago' WHEN {_AGE} < {7 * _DAY} THEN ({_AGE} // {_DAY}) || 'd ago' ELSE ({_AGE} // {7 * _DAY}) || 'w ago' END")
_derived("fmt_asn", lambda: exprs.format_asn(_c("sysRowId") % 7), "CASE WHEN sysRowId % 7 <> 0 THEN 'AS' || (sysRowId % 7) END")
_derived("fmt_sampling", lambda: exprs.sampling_rate(_c("sysRowId") % 7), "CASE WHEN sysRowId % 7 <> 0 THEN '1:' || (sysRowId % 7) END")
_derived("fmt_interface", lambda: exprs.interface_name(_c("sysRowId") % 7, F.when(_c("sysRowId") % 7 > 3, "eth0"), True), "CASE WHEN sysRowId % 7 > 3 THEN 'eth0 (' || (sysRowId % 7) || ')' ELSE 'if' || (sysRowId % 7) END")
_derived("fmt_cidr", lambda: exprs.format_cidr(_c("sourceIPv4Address"), F.when(_c("sysRowId") % 2 == 0, 24)), _IP.format("sourceIPv4Address") + " || CASE WHEN sysRowId % 2 = 0 THEN '/24' ELSE '' END")
_ip6 = lambda: F.unhex(F.concat(F.lit("20010db8"), F.lpad(F.hex(_c("sysRowId") % 65536), 24, "0")))
_derived("fmt_ipv6", lambda: exprs.ipv6_text(_ip6()), "CASE WHEN sysRowId % 65536 = 0 THEN '2001:db8::' ELSE '2001:db8::' || printf('%x', sysRowId % 65536) END")
_times = {"flowStartMilliseconds": (4, "sysExportTime - 10"), "flowStartSeconds": (3, "sysExportTime div 1000 - 1"), "systemInitTimeMilliseconds": (2, "sysExportTime - 5000"), "flowStartSysUpTime": (2, "1000L")}


def _with_times(df: DataFrame) -> DataFrame:
    return df.withColumns({n: F.expr(f"CASE WHEN sysRowId % 5 >= {k} THEN {e} END") for n, (k, e) in _times.items()})


QUERIES["derived_start"] = lambda spark, d: (lambda df: df.select("sysRowId", exprs.flow_time(df.columns, "Start").alias("x")))(_with_times(flows(spark, d)))
SQL["derived_start"] = _sql("SELECT sysRowId, CASE sysRowId % 5 WHEN 4 THEN sysExportTime - 10 WHEN 3 THEN (sysExportTime // 1000 - 1) * 1000 WHEN 2 THEN sysExportTime - 4000 ELSE sysExportTime END AS x FROM flows")
_derived("fmt_time", lambda: exprs.format_time(_c("sysExportTime")), "strftime(make_timestamp(sysExportTime * 1000), '%Y-%m-%d %H:%M:%S.%g')")


# A view with an IPv6 address, a flag and a port list, for tests on those kinds.
def _wide(spark: SparkSession, d: str) -> DataFrame:
    return flows(spark, d).withColumns({"sourceIPv6Address": _ip6(), "isMulticast": _c("sysRowId") % 3 == 0})


def _wider(name: str, query: str | dict, where: str, **how) -> None:
    asked = parse(f"{_ALL} | {query} | {_IDS}") if isinstance(query, str) else from_json({"time_range": {"type": "absolute", "start": "2024-01-01", "end": "2024-02-01"}, "filters": [query], "columns": ["sysRowId", "sysExportTime"]})
    QUERIES[name] = lambda spark, d: _plain(plan(asked, _wide(spark, d), **how))
    SQL[name] = _sql(f"SELECT sysRowId, sysExportTime {_W} AND ({where})")


_wider("ip6_eq", "src 2001:db8::1f4", "sysRowId % 65536 = 500")
_wider("ip6_cidr", "src 2001:db8::100/120", "sysRowId % 65536 BETWEEN 256 AND 511")
_wider("ip6_list", {"field": "src", "op": "in", "value": ["2001:db8::1", "2001:db8::2", "10.0.30.239"]}, "sysRowId % 65536 IN (1, 2) OR sourceIPv4Address = 167780079")
_wider("bool_eq", {"field": "isMulticast", "op": "eq", "value": True}, "sysRowId % 3 = 0")
_wider("bool_ne", {"field": "isMulticast", "op": "ne", "value": True}, "sysRowId % 3 <> 0")
_wider("num_not_in", {"field": "packets", "op": "not_in", "value": [1, 2, 3]}, "packetDeltaCount NOT IN (1, 2, 3)")
_wider("str_not_in", {"field": "app", "op": "not_in", "value": ["click", "view"]}, "applicationName NOT IN ('click', 'view')")
_wider("mac_in", {"field": "srcmac", "op": "in", "value": ["00:00:00:64:00:64", "000000650065"]}, "sourceMacAddress IN ('000000640064', '000000650065')")
_wider("ip_octet_range", "dst 192.168.1-2.7", "destinationIPv4Address IN (3232235783, 3232236039)")
_wider("json_negated_group", {"logic": "or", "negated": True, "filters": [{"field": "proto", "op": "eq", "value": "udp"}, {"field": "dport", "op": "in", "value": [80, 443]}]}, "NOT (protocolIdentifier = 17 OR destinationTransportPort IN (80, 443))")
QUERIES["group_subnet6"] = lambda spark, d: _plain(plan(f"{_ALL} | group by sourceIPv6Address /120 | count()", _wide(spark, d)))
SQL["group_subnet6"] = _sql(f"SELECT '2001:0db8:0000:0000:0000:0000:0000:' || printf('%04x', sysRowId % 65536 // 256 * 256) || '/120' AS sourceIPv6Address_120, count(*) AS count {_W} GROUP BY 1")
_add("time_default", f"| {_IDS}", f"SELECT sysRowId, sysExportTime FROM flows WHERE sysExportTime BETWEEN {_NOW - 3_600_000} AND {_NOW}")
_RANGE = {"type": "absolute", "start": "2024-01-01", "end": "2024-02-01"}
_add("json_relative", {"time_range": {"type": "relative", "duration": "2h"}, "columns": ["sysRowId", "sysExportTime"]}, f"SELECT sysRowId, sysExportTime FROM flows WHERE sysExportTime BETWEEN {_NOW - 7_200_000} AND {_NOW}")
_add("json_top_n", {"time_range": _RANGE, "columns": ["sysRowId", "bytes"], "aggregate": {"type": "top_n", "n": 10, "function": "sum", "field": "bytes", "bottom": False}}, f"SELECT sysRowId, octetDeltaCount {_W} ORDER BY octetDeltaCount DESC, {_NEW} LIMIT 10")
_add("json_sort", {"time_range": _RANGE, "columns": ["sysRowId", "packets"], "aggregate": {"type": "sort", "function": "sum", "field": "packets", "direction": "asc"}}, f"SELECT sysRowId, packetDeltaCount {_W} ORDER BY packetDeltaCount, {_NEW} LIMIT 40", limit=40)
_add("json_limit", {"time_range": _RANGE, "columns": ["sysRowId", "sysExportTime"], "aggregate": {"type": "limit", "n": 30}}, f"SELECT sysRowId, sysExportTime {_W} ORDER BY {_NEW} LIMIT 30")
QUERIES["page_total"] = lambda spark, d: hist.total(f"{_ALL} | dport 22", flows(spark, d))
SQL["page_total"] = _sql(f"SELECT count(*) AS total {_W} AND destinationTransportPort = 22")


def _with_uuids(spark: SparkSession, d: str) -> DataFrame:
    return flows(spark, d).withColumn("sysRowId", exprs.row_id(_c("sysExportTime"), _c("sysRowId")))


def _row_by_uuid(spark: SparkSession, d: str) -> DataFrame:
    some = _with_uuids(spark, d).where("sourceTransportPort = 1024 + 4242").orderBy("sysExportTime").first()["sysRowId"]
    return hist.row_by_id(_with_uuids(spark, d), some).drop("sysRowId")


QUERIES["row_by_uuid"] = _row_by_uuid
SQL["row_by_uuid"] = _sql("SELECT * EXCLUDE (sysRowId) FROM flows WHERE sourceTransportPort = 1024 + 4242 ORDER BY sysExportTime LIMIT 1")


def _union(spark: SparkSession, d: str) -> DataFrame:
    all_rows = flows(spark, d)
    old = all_rows.where("sysRowId % 2 = 0").drop("destinationIPv4Address", "applicationName")
    return old.unionByName(all_rows.where("sysRowId % 2 = 1"), allowMissingColumns=True).select("sysRowId", "destinationIPv4Address", "applicationName", "octetDeltaCount")


QUERIES["schema_union"] = _union
SQL["schema_union"] = _sql("SELECT sysRowId, CASE WHEN sysRowId % 2 = 1 THEN destinationIPv4Address END AS destinationIPv4Address, CASE WHEN sysRowId % 2 = 1 THEN applicationName END AS applicationName, octetDeltaCount FROM flows")

_EXPORT = ("sysRowId", "applicationName", "octetDeltaCount")
for _kind in ("ndjson", "csv", "tsv", "ltsv"):
    QUERIES[f"export_{_kind}"] = lambda spark, d, kind=_kind: export.lines(flows(spark, d).select(*_EXPORT), kind)
SQL["export_csv"] = _sql("SELECT sysRowId || ',' || applicationName || ',' || octetDeltaCount AS line FROM flows")
SQL["export_tsv"] = _sql("SELECT sysRowId || chr(9) || applicationName || chr(9) || octetDeltaCount AS line FROM flows")
SQL["export_ltsv"] = _sql("SELECT 'sysRowId:' || sysRowId || chr(9) || 'applicationName:' || applicationName || chr(9) || 'octetDeltaCount:' || octetDeltaCount AS line FROM flows")
SQL["export_ndjson"] = _sql("""SELECT '{"sysRowId":' || sysRowId || ',"applicationName":"' || applicationName || '","octetDeltaCount":' || octetDeltaCount || '}' AS line FROM flows""")

_ODD = "CASE event WHEN 0 THEN NULL WHEN 1 THEN 'a\"b' WHEN 2 THEN 'c,d' WHEN 3 THEN concat('e', chr(9), 'f') ELSE 'plain' END"


def _odd(spark: SparkSession, d: str) -> DataFrame:
    return flows(spark, d).withColumn("event", _c("sysRowId") % 5).select("sysRowId", F.expr(_ODD.replace('"', '\\"')).alias("note"))


_ODD_SQL = f"WITH o AS (SELECT sysRowId, {_ODD} AS note FROM (SELECT *, sysRowId % 5 AS event FROM flows)) "
_ODD_FORMS = {
    "csv": "SELECT 'sysRowId,note' AS line UNION ALL SELECT sysRowId || ',' || CASE WHEN note IS NULL THEN '' WHEN regexp_matches(note, '[\",]') THEN '\"' || replace(note, '\"', '\"\"') || '\"' ELSE note END FROM o",
    "tsv": "SELECT 'sysRowId' || chr(9) || 'note' AS line UNION ALL SELECT sysRowId || chr(9) || coalesce(replace(note, chr(9), ' '), '') FROM o",
    "ltsv": "SELECT 'sysRowId:' || sysRowId || coalesce(chr(9) || 'note:' || replace(note, chr(9), ' '), '') AS line FROM o",
    "json": """SELECT '{"sysRowId":' || sysRowId || ',"note":' || coalesce('"' || replace(replace(note, '"', '\\"'), chr(9), '\\t') || '"', 'null') || '}' AS line FROM o""",
}
for _kind, _body in _ODD_FORMS.items():
    QUERIES[f"export_{_kind}_odd"] = lambda spark, d, kind=_kind: export.lines(_odd(spark, d), kind, header=True)
    SQL[f"export_{_kind}_odd"] = _sql("SELECT 1").replace("SELECT 1", "").rstrip() + ", " + _ODD_SQL.removeprefix("WITH ") + _body

for _kind in ("ipfix", "netflow_v9", "netflow_v5"):
    QUERIES[f"{_kind}_decode"] = lambda spark, d, kind=_kind: samples.decoded(spark, d, kind)
    SQL[f"{_kind}_decode"] = _sql("SELECT sourceIPv4Address, destinationIPv4Address, sourceTransportPort, destinationTransportPort, protocolIdentifier, octetDeltaCount FROM flows")


QUERIES["interface_names"] = samples.interfaces
SQL["interface_names"] = _sql("SELECT 167772161 + i % 16 AS exporter, 1 AS domain, i AS interface, 'port' || i AS name FROM (SELECT DISTINCT sysRowId % 1024 AS i FROM flows)")


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """Flows stored by hour, compacted, old hours dropped, and asked by time: what is left of one day."""
    base = f"{(spark.conf.get('spark.checkpoint.dir', None) or tempfile.gettempdir() + '/checkpoints').rstrip('/')}/flows/{uuid.uuid4().hex}"
    two_days = flows(spark, d).where(_c("sysExportTime").between(_LO, _LO + 2 * _DAY - 1))
    sink.store(two_days.withColumnRenamed("sysRowId", "rid"), base)
    hour = datetime.fromtimestamp(_LO / 1000, timezone.utc)
    for k in (0, 1):
        sink.compact(spark, base, hour + timedelta(hours=k), f"{base}-compact")
        sink.compact(spark, base, hour + timedelta(hours=k), f"{base}-compact")  # again: nothing doubles
    rest = spark.read.parquet(base).where("NOT (month = 1 AND day = 1 AND hour < 2)")
    sink.store(rest.drop(*sink.PARTITIONS), f"{base}-compact")
    old = sink.expired_hours(spark, f"{base}-compact", hour + timedelta(hours=30), 24)
    sink.drop_hours(spark, f"{base}-compact", old)
    return plan("2024-01-01 | select rid, sysExportTime, src", read_flows(spark, f"{base}-compact"), STORED_LAYOUT)


QUERIES["store_compact_retain"] = _stored
SQL["store_compact_retain"] = _sql(f"SELECT sysRowId AS rid, sysExportTime, sourceIPv4Address FROM flows WHERE sysExportTime BETWEEN {_LO + 6 * 3_600_000} AND {_LO + _DAY - 1}")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return _plain(plan(f"{_ALL} | proto tcp and dport 443 | group by src /24 | sum(bytes), count()", flows(spark, d)))


QUERIES["flagship"] = flagship
SQL["flagship"] = _sql(f"SELECT {_IP.format('(sourceIPv4Address & 4294967040)')} || '/24' AS sourceIPv4Address_24, CAST(sum(octetDeltaCount) AS BIGINT) AS sum_bytes, count(*) AS count {_W} AND protocolIdentifier = 6 AND destinationTransportPort = 443 GROUP BY 1")

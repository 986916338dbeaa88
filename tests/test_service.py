import json

import pytest
from .conftest import SF

from flowlake.operators import catalog, histogram as hist
from flowlake.operators.planner import plan
from flowlake.operators.service import ResultCache, Service, events, storage_stats
from flowlake.plans.ast import QueryError
from flowlake.sources.flows import flows
from flowlake.streaming import sink

ALL = "2024-01-01..2024-02-01"
RANGE = {"type": "absolute", "start": "2024-01-01", "end": "2024-02-01"}


def test_cache_bounds_age_and_version():
    now = [0.0]
    cache = ResultCache(entries=2, size=60, age=2.0, clock=lambda: now[0])
    cache.put("a", {"x": 1}, 1)
    cache.put("b", {"x": 2}, 1)
    assert cache.get("a", 1) == {"x": 1}
    cache.put("c", {"x": 3}, 1)  # b was used least
    assert cache.get("b", 1) is None and cache.get("a", 1) and cache.get("c", 2) is None and len(cache) == 1
    now[0] = 2.0
    assert cache.get("a", 1) is None and cache.used == 0
    cache.put("d", {"x": "y" * 80}, 1)
    assert len(cache) == 0 and cache.used == 0
    ResultCache(entries=0).put("a", {})


def test_pages_to_the_end_and_cache(spark):
    source, version = flows(spark, SF).cache(), [1]
    service = Service(lambda: source, version=lambda: version[0], cache=ResultCache(age=600))
    got, cursor = [], None
    first = service.query({"query": f"{ALL} | dport 22 | select bytes, src", "limit": 60, "count": True})
    pins = first["schema_columns"]
    assert pins == ["octetDeltaCount", "sourceIPv4Address"] and [c["type"] for c in first["columns"]] == ["unsigned64", "ipv4address"]
    while True:
        page = service.query({"query": f"{ALL} | dport 22 | select bytes, src", "limit": 60, "cursor": cursor, "schema_columns": pins} if cursor is not None else {"query": f"{ALL} | dport 22 | select bytes, src", "limit": 60})
        got += page["rows"]
        cursor = page["next_cursor"]
        if cursor is None:
            break
    want = plan(f"{ALL} | dport 22", source).select("octetDeltaCount", "sourceIPv4Address").collect()
    assert got == [list(r) for r in want] and first["pagination"]["total"] == len(want) and first["pagination"]["has_more"] and not page["pagination"]["has_more"]
    again = service.query({"query": f"{ALL} | dport 22 | select bytes, src", "limit": 60, "count": True})
    assert again["stats"]["cached"] and again["rows"] == first["rows"] and service.counters["cache_hits"] == 1
    version[0] = 2
    assert not service.query({"query": f"{ALL} | dport 22 | select bytes, src", "limit": 60, "count": True})["stats"]["cached"]
    json.dumps([first, service.health()])
    assert f"flowlake_cache_hits {service.counters['cache_hits']}\n" in service.prometheus()


def test_structured_grouped_pinned_and_refused(spark):
    service = Service(lambda: flows(spark, SF), now_ms=lambda: 1_706_000_000_000, row_guard=100)
    relative = service.query({"time_range": {"type": "relative", "duration": "1h"}, "filters": [], "logic": "and"})
    assert relative["time_range"] == {"start": 1_705_996_400_000, "end": 1_706_000_000_000} and {"parsed", "columns", "rows", "stats", "explain", "pagination"} <= set(relative)
    assert "more than the limit" in service.query(f"{ALL} | group by dport | count()")["error"]
    assert service.query("last 1h | sort")["position"] is not None and service.query({"filters": [{"op": "eq"}]})["error"]
    service.row_guard = None
    groups = service.query(f"{ALL} | group by dport | count()")
    assert [c["type"] for c in groups["columns"]] == ["unsigned16", "number"] and groups["next_cursor"] is None and not groups["pagination"]["has_more"]
    pinned = service.query({"time_range": RANGE, "columns": ["sysRowId"], "limit": 2, "time_start": 0, "time_end": 1, "schema_columns": ["sysRowId", "gone"]})
    assert pinned["rows"] == [] and pinned["schema_columns"] == ["sysRowId", "gone"] and pinned["time_range"] == {"start": 0, "end": 1}
    star = service.query({"query": f"{ALL} | select * except (sysRowId)", "limit": 1})
    assert "sysRowId" not in star["schema_columns"] and star["next_cursor"] is not None
    with pytest.raises(QueryError):
        plan(f"{ALL} | top 3 by count()", flows(spark, SF), row_guard=1)


def test_histogram_events(spark):
    service = Service(lambda: flows(spark, SF))
    answers = list(service.histogram({"time_range": RANGE, "filters": [{"field": "dport", "op": "eq", "value": 22}]}, parts=4))
    lo, hi = 1704067200000, 1706745600000
    whole = hist.histogram(flows(spark, SF).where("destinationTransportPort = 22"), lo, hi).collect()
    assert [a["done"] for a in answers] == [False] * (len(answers) - 1) + [True] and 2 <= len(answers) <= 4
    assert {b["timestamp"]: b["count"] for b in answers[-1]["buckets"]} == {r["bucket"]: r["count"] for r in whole}
    assert all(a["total_rows"] <= b["total_rows"] for a, b in zip(answers, answers[1:], strict=False))
    assert next(events(iter(answers))).startswith("event: progress\ndata: {") and list(service.histogram({"time_range": {"type": "odd"}}))[0]["done"]
    assert hist.progressive(5, 5) == [(5 // 1000 * 1000, 5, 1000, True)]


def test_schema_types_and_columns(spark):
    schema = Service(lambda: flows(spark, SF)).schema()
    assert {"ipv4", "port", "string", "numeric", "protocol", "mac"} <= set(schema["filter_types"]) and schema["op_hints"]["cidr"]
    by_name = {f["name"]: f for f in schema["fields"]}
    assert by_name["src"]["alias_of"] == "sourceIPv4Address" and by_name["src"]["filter_type"] == "ipv4" and by_name["proto"]["filter_type"] == "protocol" and by_name["sourceMacAddress"]["filter_type"] == "mac"
    assert [by_name[n]["semantic_hint"] for n in ("flowDurationMilliseconds", "tcpControlBits", "octetDeltaCount", "sysExportTime", "applicationName")] == ["duration_ms", "tcp_flags", "counter", "timestamp_ms", ""]
    assert all(t in schema["op_hints"] for ts in schema["filter_types"].values() for t in ts)
    types = {r.name: r.type for r in catalog.elements(spark, {(9, 5): ("vendorField", "str")}).collect()}
    assert types["flowStartSeconds"] == "datetimeseconds" and types["vendorField"] == "string" and types["sourceMacAddress"] == "macaddress"
    assert catalog.result_type("sum(bytes)") == "number" and catalog.result_type("nothing") == "unknown"
    assert catalog.visible_columns(["packetDeltaCount", "x", "sourceIPv4Address", "sysExportTime"]) == ["sysExportTime", "sourceIPv4Address", "packetDeltaCount"]
    assert catalog.visible_columns(["x", "sysExportTime"]) == ["x", "sysExportTime"] and catalog.visible_columns(["sysExportTime", "sourceIPv4Address", "octetDeltaCount", "sum(bytes)"])[-1] == "sum(bytes)"


def test_storage_stats(spark, tmp_path):
    sink.store(flows(spark, SF).where("sysExportTime < 1704067200000 + 7200000"), str(tmp_path / "t"))
    got = storage_stats(spark, str(tmp_path / "t")).collect()
    assert got and all(r.files >= 1 and r.bytes > 0 and r.hour.startswith("year=2024/month=1/day=1/hour=") for r in got)

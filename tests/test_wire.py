import random
import struct
from datetime import datetime, timezone

import pytest

from flowlake.operators.planner import plan
from flowlake.sources.flows import STORED_LAYOUT, flows, read_flows
from flowlake.sources.samples import COLUMNS, datagrams, decoded, message
from flowlake.sources.wire import Session, WireError, decode, value
from flowlake.streaming import sink
from flowlake.streaming.decode import SCHEMA, decode_batch, decode_stream, interface_names

ROW = (3232235777, 167772161, 1234, 80, 6, 999)
EXPORTER = (167772161, 4739)


def ipfix(*sets, seconds=1_700_000_000, domain=1):
    body = b"".join(struct.pack(">HH", n, len(b) + 4) + b for n, b in sets)
    return struct.pack(">HHIII", 10, 16 + len(body), seconds, 1, domain) + body


TEMPLATE = struct.pack(">HHHHHH", 256, 2, 8, 4, 12, 4)
DATA = bytes.fromhex("c0a801010a000001")


@pytest.mark.parametrize("kind", ["ipfix", "netflow_v9", "netflow_v5"])
def test_formats(kind):
    r = decode(message(kind, [ROW, ROW]), EXPORTER, Session(), 0)
    assert len(r) == 2 and (r[0]["sourceIPv4Address"], r[0]["destinationTransportPort"], r[0]["octetDeltaCount"]) == (3232235777, 80, 999)
    assert r[0]["sysExportTime"] == 1_700_000_000_000
    if kind == "netflow_v5":
        assert r[0]["sysFlowDuration"] == 10 and r[0]["sysObservationDomainId"] == 258


def test_late_template_and_scopes():
    s = Session()
    assert decode(ipfix((256, DATA)), EXPORTER, s, 0) == []
    assert decode(ipfix((2, TEMPLATE), domain=2), EXPORTER, s, 0) == []
    assert len(decode(ipfix((2, TEMPLATE)), EXPORTER, s, 0)) == 1 and not s.waiting
    assert decode(ipfix((256, DATA)), (5, 6), s, 0) == []
    s.expire(400)
    assert not s.waiting and s.templates
    s.expire(4000)
    assert not s.templates


def test_withdrawal_padding_reserved():
    s = Session()
    assert len(decode(ipfix((2, TEMPLATE), (100, b"zzzz"), (256, DATA + b"\0\0\0")), EXPORTER, s, 0)) == 1
    decode(ipfix((2, struct.pack(">HH", 256, 0))), EXPORTER, s, 0)
    assert not s.templates


def test_options_give_interface_names():
    s = Session()
    t = struct.pack(">HHHHHHH", 257, 2, 1, 10, 4, 82, 65535)
    d = struct.pack(">I", 1) + b"\x07Gig0/0\0" + struct.pack(">I", 2) + b"\xff\x00\x03Lo0"
    assert decode(ipfix((3, t), (257, d)), EXPORTER, s, 0) == []
    assert list(s.interfaces.values()) == ["Gig0/0", "Lo0"]


def test_enterprise_reduced_and_odd_lengths():
    s = Session()
    t = struct.pack(">HHHHIHH", 256, 2, 0x8000 | 5, 3, 9, 1, 2)
    r = decode(ipfix((2, t), (256, b"abc\x01\x00")), EXPORTER, s, 0)[0]
    assert r["pen9.ie5"] == b"abc" and r["octetDeltaCount"] == 256
    assert value(b"\xff", "i32") == -1 and value(b"\0" * 9, "u64") == b"\0" * 9


@pytest.mark.parametrize("data", [b"", b"\0\x0b" + b"\0" * 30, struct.pack(">HHIII", 10, 99, 0, 0, 0), b"\0\x0a\0"])
def test_bad_messages(data):
    with pytest.raises(WireError):
        decode(data, EXPORTER, Session(), 0)


def test_old_export_time_is_replaced():
    assert decode(ipfix((2, TEMPLATE), (256, DATA), seconds=5), EXPORTER, Session(), 1_700_000_001)[0]["sysExportTime"] == 1_700_000_001_000


def test_stream_store_compact_retain(spark, tmp_path):
    grams = [(EXPORTER[0], EXPORTER[1], 1, 0, ipfix((256, DATA))), (EXPORTER[0], EXPORTER[1], 2, 1, ipfix((2, TEMPLATE))), (EXPORTER[0], EXPORTER[1], 3, 2, b"bad")]
    schema = "exporter_ip long, exporter_port int, received_ms long, seq long, data binary"
    src, out = str(tmp_path / "in"), str(tmp_path / "flows")
    df = spark.createDataFrame(grams, schema)
    assert decode_batch(df).count() == 1
    df.write.parquet(src)
    flows = decode_stream(spark.readStream.schema(schema).parquet(src))
    q = sink.store_stream(flows, out, str(tmp_path / "cp"), once=True)
    assert q.awaitTermination(90) and q.exception() is None
    stored = spark.read.parquet(out)
    assert [(r.sourceIPv4Address, r.year, r.hour) for r in stored.collect()] == [(3232235777, 2023, 22)]
    batch, merged = str(tmp_path / "batch"), str(tmp_path / "compact")
    sink.store(decode_batch(df), batch)
    sink.store(sink.with_row_ids(decode_batch(df)), batch)  # a second schema in the same hour
    hour = datetime(2023, 11, 14, 22, tzinfo=timezone.utc)
    sink.compact(spark, batch, hour, merged)
    rows = spark.read.parquet(merged)
    assert rows.count() == 2 and rows.select("sysRowId").distinct().count() == 2 and rows.where("sysRowId IS NULL").isEmpty()
    sink.compact(spark, batch, hour, merged)  # again: the hour is replaced
    assert spark.read.parquet(merged).count() == 2
    found = plan("2023-11-14..2023-11-15 | src 192.168.1.1 | select sysRowId, src", read_flows(spark, merged), STORED_LAYOUT)
    assert found.count() == 2 and "PartitionFilters: [isnotnull(year" in found._jdf.queryExecution().toString()
    assert sink.expired_hours(spark, merged, datetime(2024, 1, 14, tzinfo=timezone.utc)) == [hour]
    assert sink.expired_hours(spark, merged, datetime(2024, 1, 14, tzinfo=timezone.utc), 0) == []
    sink.drop_hours(spark, merged, [hour])
    assert not (tmp_path / "compact/year=2023/month=11/day=14/hour=22").exists()
    assert SCHEMA


CUT = [
    ipfix((2, struct.pack(">HHHH", 256, 1, 0x8001, 4))),  # within an enterprise field
    ipfix((3, struct.pack(">HH", 256, 2))),  # an options template without scopes
    struct.pack(">HHIIII", 9, 1, 1, 1_700_000_000, 1, 1) + struct.pack(">HHHH", 1, 8, 256, 4),
    ipfix((2, struct.pack(">HHHH", 256, 1, 82, 65535)), (256, b"\xff\x01")),  # within a long length
]


@pytest.mark.parametrize("data", CUT)
def test_cut_sets_are_refused(data):
    with pytest.raises(WireError):
        decode(data, EXPORTER, Session(), 0)


def test_any_bytes_are_decoded_or_refused(spark):
    """Whole messages with bytes changed or cut: no other error, and other messages of the batch still come."""
    rnd = random.Random(7)
    options = ipfix((3, struct.pack(">HHHHHHH", 257, 2, 1, 10, 4, 82, 65535)), (257, struct.pack(">I", 1) + b"\x02e0"))
    whole = [message(k, [ROW] * 3) for k in ("ipfix", "netflow_v9", "netflow_v5")] + [options, *CUT]
    broken = []
    for k in range(4000):
        data = bytearray(whole[k % len(whole)])
        for _ in range(rnd.randint(1, 6)):
            data[rnd.randrange(2, len(data))] = rnd.randrange(256)
        broken.append(bytes(data[: rnd.randint(2, len(data))] if rnd.random() < 0.3 else data))
    session = Session()
    for data in broken:
        try:
            decode(data, EXPORTER, session, 0)
        except WireError:
            pass
    top = ipfix((2, struct.pack(">HHHHHH", 256, 2, 8, 4, 1, 8)), (256, bytes(4) + b"\xff" * 8))
    grams = [(EXPORTER[0], k % 3, k, k, data) for k, data in enumerate(broken[:300])] + [(9, 9, 1, 1, CUT[0]), (9, 9, 2, 2, top)]
    df = spark.createDataFrame(grams, "exporter_ip long, exporter_port int, received_ms long, seq long, data binary")
    assert [r.octetDeltaCount for r in decode_batch(df).where("sysExporterIPv4 = 9").collect()] == [(1 << 63) - 1]


def test_spool_is_bounded():
    s = Session(spool_bytes=10_000)
    for _ in range(500):
        decode(ipfix((300, b"x" * 100)), EXPORTER, s, 0)
    assert sum(len(w[3]) for w in s.waiting) <= 10_000 + 64 * 100 and s.lost > 300


def test_interface_names(spark):
    t = struct.pack(">HHHHHHH", 257, 2, 1, 10, 4, 82, 65535)
    d = lambda n, name: struct.pack(">I", n) + bytes([len(name)]) + name
    grams = [(5, 1, 1, 0, ipfix((3, t), (257, d(1, b"a0") + d(2, b"b0")))), (5, 1, 2, 1, ipfix((257, d(1, b"a1")))), (6, 1, 1, 0, ipfix((257, d(7, b"no template"))))]
    df = spark.createDataFrame(grams, "exporter_ip long, exporter_port int, received_ms long, seq long, data binary")
    assert {tuple(r) for r in interface_names(df).collect()} == {(5, 1, 1, "a1"), (5, 1, 2, "b0")}


def test_decoded_columns_keep_known_elements(spark):
    fields = ((8, 4), (152, 8), (153, 8), (136, 1), (468, 65535), (460, 65535))
    t = struct.pack(">HH", 256, len(fields)) + b"".join(struct.pack(">HH", *f) for f in fields)
    d = struct.pack(">IQQB", 1, 1000, 2500, 3) + b"\x03a.b" + b"\x03GET"
    df = spark.createDataFrame([(5, 1, 1, 0, ipfix((2, t), (256, d)))], "exporter_ip long, exporter_port int, received_ms long, seq long, data binary")
    r = decode_batch(df).first()
    assert (r.flowStartMilliseconds, r.flowEndMilliseconds, r.flowEndReason, r.dnsQueryName, r.httpRequestMethod, r.sysFlowDuration) == (1000, 2500, 3, "a.b", "GET", 1500)


@pytest.mark.parametrize("kind", ["ipfix", "netflow_v9", "netflow_v5"])
def test_whole_table_over_many_exporters(spark, kind):
    sf = "/root/testdata/sf0.01"
    want = flows(spark, sf).selectExpr(*[f"CAST({c} AS BIGINT) AS {c}" for c in COLUMNS])
    got = decoded(spark, sf, kind).selectExpr(*[f"CAST({c} AS BIGINT) AS {c}" for c in COLUMNS])
    assert got.count() == want.count() > 3000 and got.exceptAll(want).isEmpty()
    assert datagrams(spark, sf, kind).select("exporter_ip", "exporter_port").distinct().count() > 100

import socket
import threading
import time

from flowlake.operators.catalog import complete, describe, with_interface_names
from flowlake.sources.samples import message
from flowlake.streaming.listener import DatagramReader, _Inbox
from flowlake.streaming.metrics import StreamMetrics


def test_describe_and_complete(spark):
    df = spark.createDataFrame([], "sourceIPv4Address long, sourceTransportPort int, sourceMacAddress string, sourceIPv6Address binary, octetDeltaCount long")
    got = {d["name"]: d for d in describe(df)}
    assert got["sourceIPv4Address"]["type"] == "ipv4" and "cidr" in got["sourceIPv4Address"]["tests"] and got["octetDeltaCount"]["aliases"] == ["bytes"]
    assert "named" in got["sourceTransportPort"]["tests"] and got["sourceIPv6Address"]["type"] == "ipv6" and "prefix" in got["sourceMacAddress"]["tests"]
    assert ("ssh", "port") in complete("SS") and ("sum()", "function") in complete("su") and ("sourceIPv4Address", "field") in complete("sourceip", df)


def test_interface_names(spark):
    flows = spark.createDataFrame([(1, 1, 5, 6), (1, 2, 5, None)], "sysExporterIPv4 long, sysObservationDomainId long, ingressInterface long, egressInterface long")
    names = spark.createDataFrame([(1, 1, 5, "eth5")], "exporter long, domain long, interface long, name string")
    assert sorted((r.ingressName, r.egressName or "") for r in with_interface_names(flows, names).collect()) == [("5", ""), ("eth5", "6")]


def free_port(kind):
    with socket.socket(socket.AF_INET, kind) as s:
        s.bind(("127.0.0.1", 0))
        return s.getsockname()[1]


def wait(reader, n):
    for _ in range(100):
        rows, end = reader.read({"seq": 0})
        if len(rows := list(rows)) >= n:
            return rows, end
        time.sleep(0.05)
    raise AssertionError("nothing received")


def test_listeners():
    data = message("ipfix", [(1, 2, 3, 4, 6, 5)])
    port = free_port(socket.SOCK_DGRAM)
    udp = DatagramReader({"host": "127.0.0.1", "port": str(port)})
    time.sleep(0.2)
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.sendto(data, ("127.0.0.1", port))
    rows, end = wait(udp, 1)
    assert rows[0][0] == 0x7F000001 and rows[0][4] == data and list(udp.readBetweenOffsets({"seq": 0}, end)) == rows
    udp.commit(end)
    assert list(udp.read({"seq": 0})[0]) == []
    port = free_port(socket.SOCK_STREAM)
    tcp = DatagramReader({"host": "127.0.0.1", "port": str(port), "protocol": "tcp"})
    time.sleep(0.2)
    with socket.create_connection(("127.0.0.1", port)) as s:
        s.sendall(data + data + data[:-3])
    time.sleep(0.2)
    assert [r[4] for r in wait(tcp, 2)[0]] == [data, data]  # the cut one isn't delivered


def test_inbox_is_bounded():
    box = _Inbox(10)
    for data in (b"123456", b"7890", b"x"):
        box.put(("127.0.0.1", 1), data)
    assert (box.dropped, box.used, box.next) == (1, 10, 2)
    sender = threading.Thread(target=box.put, args=(("127.0.0.1", 1), b"waits", True))
    sender.start()
    sender.join(0.2)
    assert sender.is_alive()
    box.forget(1)
    sender.join(5)
    assert not sender.is_alive() and [r[4] for r in box.between(0, 9)] == [b"7890", b"waits"]
    box.forget(3)
    box.put(("127.0.0.1", 1), b"larger than all")
    assert box.used == 15 and box.next == 4


def test_batches_and_restart():
    port = free_port(socket.SOCK_DGRAM)
    reader = DatagramReader({"host": "127.0.0.1", "port": str(port), "batch_rows": "2"})
    for k in range(3):
        reader.inbox.put(("127.0.0.1", 1), bytes([k]))
    rows, end = reader.read({"seq": 500})  # the checkpoint is ahead of a new inbox
    assert [(r[3], r[4]) for r in rows] == [(500, b"\x00"), (501, b"\x01")] and end == {"seq": 502}
    reader.commit(end)
    rows, end = reader.read(end)
    assert [r[4] for r in rows] == [b"\x02"] and end == {"seq": 503}
    assert list(reader.readBetweenOffsets({"seq": 503}, {"seq": 600})) == [] and reader.inbox.next >= 600


def test_stream_metrics(spark, tmp_path):
    metrics = StreamMetrics()
    spark.streams.addListener(metrics)
    try:
        spark.range(5).write.parquet(str(tmp_path / "in"))
        q = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        for _ in range(100):
            if metrics.values()["streams_ended"]:
                break
            time.sleep(0.05)
    finally:
        spark.streams.removeListener(metrics)
    got = metrics.values()
    assert (got["streams_started"], got["streams_ended"], got["streams_failed"], got["rows_in"]) == (1, 1, 0, 5) and "flowlake_rows_in 5\n" in metrics.prometheus()

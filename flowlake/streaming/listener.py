"""UDP and TCP listeners as a streaming source: spark.readStream.format("flow_datagrams").

Options: host, port, protocol (udp or tcp; tcp takes length-framed version 10 messages only), inbox_bytes (how much may wait
for its batch, 256 MB), batch_rows (the most datagrams of a batch, all that wait by default). Beyond inbox_bytes tcp senders wait
and udp datagrams are dropped and counted, since udp can't be held back. A message that its connection cuts off isn't delivered.
The listener is on the driver; for more traffic than one host takes, let collectors write datagrams to a log or files and stream
from there. Received datagrams are kept until their batch is committed, so a failed batch is read again; a restarted driver
starts anew, with numbers after those of its checkpoint.
"""

from __future__ import annotations

import socket
import threading
import time

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "exporter_ip long, exporter_port int, received_ms long, seq long, data binary"


class _Inbox:
    """Datagrams by sequence number, without gaps, bounded in bytes."""

    def __init__(self, size: int = 256 << 20):
        self.rows: dict[int, tuple] = {}
        self.next, self.size, self.used, self.dropped = 0, size, 0, 0
        self.room = threading.Condition()

    def put(self, address: tuple, data: bytes, wait: bool = False) -> None:
        """wait: until there is room, else what has none is dropped. One datagram always fits an empty inbox."""
        ip = int.from_bytes(socket.inet_aton(address[0]), "big")
        fits = lambda: not self.rows or self.used + len(data) <= self.size
        with self.room:
            if wait:
                self.room.wait_for(fits)
            elif not fits():
                self.dropped += 1
                return
            self.rows[self.next] = (ip, address[1], int(time.time() * 1000), self.next, data)
            self.next += 1
            self.used += len(data)

    def begin(self, at: int) -> None:
        """What has come in goes on at this number, if it isn't there yet: after a restart the checkpoint is ahead."""
        if at > self.next:
            waiting = [self.rows[k] for k in sorted(self.rows)]
            self.rows = {at + k: (*r[:3], at + k, r[4]) for k, r in enumerate(waiting)}
            self.next = at + len(waiting)

    def between(self, lo: int, hi: int) -> list[tuple]:
        return [self.rows[k] for k in range(lo, min(hi, self.next)) if k in self.rows]

    def forget(self, end: int) -> None:
        with self.room:
            for k in [k for k in self.rows if k < end]:
                self.used -= len(self.rows.pop(k)[4])
            self.room.notify_all()


def _udp(inbox: _Inbox, host: str, port: int) -> None:
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind((host, port))
        while True:
            data, address = s.recvfrom(65535)
            inbox.put(address, data)


def _stream(inbox: _Inbox, link: socket.socket, address: tuple) -> None:
    with link, link.makefile("rb") as f:
        while len(head := f.read(4)) == 4:
            version, size = int.from_bytes(head[:2], "big"), int.from_bytes(head[2:], "big")
            if version != 10 or size < 16:
                return
            body = f.read(size - 4)
            if len(body) < size - 4:
                return
            inbox.put(address, head + body, wait=True)


def _tcp(inbox: _Inbox, host: str, port: int) -> None:
    with socket.create_server((host, port)) as s:
        while True:
            link, address = s.accept()
            threading.Thread(target=_stream, args=(inbox, link, address), daemon=True).start()


class DatagramReader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.inbox = _Inbox(int(options.get("inbox_bytes", 256 << 20)))
        self.most = int(options.get("batch_rows", 0)) or None
        run = _tcp if options.get("protocol", "udp") == "tcp" else _udp
        threading.Thread(target=run, args=(self.inbox, options.get("host", "0.0.0.0"), int(options.get("port", "4739"))), daemon=True).start()

    def initialOffset(self) -> dict:
        return {"seq": 0}

    def read(self, start: dict):
        with self.inbox.room:
            self.inbox.begin(start["seq"])
            end = self.inbox.next if self.most is None else min(self.inbox.next, start["seq"] + self.most)
            return iter(self.inbox.between(start["seq"], end)), {"seq": end}

    def readBetweenOffsets(self, start: dict, end: dict):
        with self.inbox.room:
            self.inbox.begin(end["seq"])
            return iter(self.inbox.between(start["seq"], end["seq"]))

    def commit(self, end: dict) -> None:
        self.inbox.forget(end["seq"])


class DatagramSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "flow_datagrams"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema):
        return DatagramReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(DatagramSource)

"""IPFIX, NetFlow v9 and NetFlow v5 messages to records."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from ..functions import tables

# Fixed values of the formats.
_V5_HEADER, _V5_RECORD = struct.Struct(">HHIIIIBBH"), struct.Struct(">IIIHHIIIIHHBBBBHHBBH")
_V9_VENDOR = {40001: 225, 40002: 226, 40003: 227, 40004: 228}
_UNSIGNED = {"u8": 1, "u16": 2, "u32": 4, "u64": 8, "sec": 4, "ms": 8}
_SIGNED = {"i8": 1, "i16": 2, "i32": 4, "i64": 8}


class WireError(ValueError):
    pass


@dataclass
class Template:
    fields: list[tuple[int, int, int]]  # enterprise, element, length (65535: variable)
    scopes: int = 0
    seen: float = 0.0


@dataclass
class Session:
    """What is known of exporters: templates by (exporter, domain, id), interface names, and sets that wait for a template."""

    templates: dict[tuple, Template] = field(default_factory=dict)
    interfaces: dict[tuple, str] = field(default_factory=dict)
    waiting: list[tuple] = field(default_factory=list)
    registry: dict | None = None
    #: Bytes that may wait for templates; beyond it the oldest sets go, and count as lost.
    spool_bytes: int = 16 << 20
    lost: int = 0

    def wait(self, found: tuple) -> None:
        self.waiting.append(found)
        size = sum(len(w[3]) for w in self.waiting) if len(self.waiting) % 64 == 0 or len(found[3]) > self.spool_bytes // 64 else 0
        while size > self.spool_bytes and self.waiting:
            size -= len(self.waiting.pop(0)[3])
            self.lost += 1

    def expire(self, now: float, template_age: float = 1800, spool_age: float = 300) -> None:
        self.templates = {k: t for k, t in self.templates.items() if now - t.seen <= template_age}
        self.waiting = [w for w in self.waiting if now - w[0] <= spool_age]


def _short(layout: str, body: bytes, at: int) -> tuple:
    """Numbers at a place of a set; a set that ends before them is refused."""
    if at + struct.calcsize(layout) > len(body):
        raise WireError("set is cut off")
    return struct.unpack_from(layout, body, at)


def value(data: bytes, kind: str):
    """A field as its type says; other lengths than the type allows stay bytes."""
    n = len(data)
    if kind in _UNSIGNED and 0 < n <= _UNSIGNED[kind]:
        return int.from_bytes(data, "big")
    if kind in _SIGNED and 0 < n <= _SIGNED[kind]:
        return int.from_bytes(data, "big", signed=True)
    if kind == "ip4" and n == 4:
        return int.from_bytes(data, "big")
    if kind in ("f32", "f64") and n in (4, 8):
        return struct.unpack(">f" if n == 4 else ">d", data)[0]
    if kind == "mac" and n == 6:
        return data.hex()
    if kind == "str":
        return data.decode("utf-8", "replace").rstrip("\0")
    return data


def _templates(body: bytes, options: bool, v9: bool, session: Session, where: tuple, now: float) -> None:
    at = 0
    while at + 4 <= len(body):
        number, count = struct.unpack_from(">HH", body, at)
        at += 4
        scopes = 0
        if options and v9:
            scope_bytes, option_bytes = count, _short(">H", body, at)[0]
            at, scopes, count = at + 2, scope_bytes // 4, (scope_bytes + option_bytes) // 4
        elif options and count:
            scopes = _short(">H", body, at)[0]
            at += 2
        if number < 256 and number not in (2, 3):
            return  # padding
        if count == 0:
            for k in [k for k in session.templates if k[:-1] == where and (k[-1] == number or number in (2, 3))]:
                del session.templates[k]
            continue
        fields = []
        for k in range(count):
            element, length = _short(">HH", body, at)
            at += 4
            enterprise = 0
            if element & 0x8000 and not v9:
                enterprise = _short(">I", body, at)[0]
                element, at = element & 0x7FFF, at + 4
            elif v9:
                element = 10 if k < scopes and element == 2 else _V9_VENDOR.get(element, element)
            fields.append((enterprise, element, length))
        session.templates[(*where, number)] = Template(fields, scopes, now)


def _records(body: bytes, template: Template, session: Session):
    least = sum(1 if n == 65535 else n for _, _, n in template.fields)
    at = 0
    while least and at + least <= len(body):
        row = {}
        for enterprise, element, length in template.fields:
            if length == 65535:
                if at >= len(body):
                    return
                length, at = body[at], at + 1
                if length == 255:
                    length, at = _short(">H", body, at)[0], at + 2
            if at + length > len(body):
                return
            name, kind = tables.element(enterprise, element, session.registry)
            row[name] = value(body[at : at + length], kind)
            at += length
        yield row


def _emit(body: bytes, template: Template, session: Session, where: tuple, seconds: int, out: list[dict]) -> None:
    for row in _records(body, template, session):
        if template.scopes:
            name = row.get("interfaceName") or row.get("interfaceDescription")
            number = row.get("ingressInterface", row.get("egressInterface"))
            if name and number is not None:
                session.interfaces[(*where, number)] = name
            continue
        out.append({"sysExporterIPv4": where[0], "sysExporterPort": where[1], "sysExportTime": seconds * 1000, "sysObservationDomainId": where[2]} | row | _duration(row))


def _duration(row: dict) -> dict:
    if "flowDurationMilliseconds" in row:
        return {}
    for start, end, scale in (("flowStartMilliseconds", "flowEndMilliseconds", 1), ("flowStartSeconds", "flowEndSeconds", 1000), ("flowStartSysUpTime", "flowEndSysUpTime", 1)):
        if start in row and end in row:
            return {"sysFlowDuration": min(max(row[end] - row[start], 0) * scale, 0xFFFFFFFF)}
    return {}


def _v5(data: bytes, exporter: tuple, now: float) -> list[dict]:
    version, count, uptime, seconds, nanos, _, engine_type, engine, sampling = _V5_HEADER.unpack_from(data)
    out = []
    for k in range(min(count, (len(data) - 24) // 48)):
        src, dst, hop, inp, outp, packets, octets, first, last, sport, dport, _, flags, proto, tos, src_as, dst_as, src_mask, dst_mask, _ = _V5_RECORD.unpack_from(data, 24 + 48 * k)
        row = {
            "sourceIPv4Address": src, "destinationIPv4Address": dst, "ipNextHopIPv4Address": hop, "ingressInterface": inp, "egressInterface": outp, "packetDeltaCount": packets, "octetDeltaCount": octets,
            "flowStartSysUpTime": first, "flowEndSysUpTime": last, "sourceTransportPort": sport, "destinationTransportPort": dport, "tcpControlBits": flags, "protocolIdentifier": proto,
            "ipClassOfService": tos, "bgpSourceAsNumber": src_as, "bgpDestinationAsNumber": dst_as, "sourceIPv4PrefixLength": src_mask, "destinationIPv4PrefixLength": dst_mask,
        }
        out.append({"sysExporterIPv4": exporter[0], "sysExporterPort": exporter[1], "sysExportTime": seconds * 1000, "sysObservationDomainId": engine_type << 8 | engine} | row | _duration(row))
    return out


def decode(data: bytes, exporter: tuple, session: Session, now: float) -> list[dict]:
    """Flow records of one datagram. Sets whose template is missing wait in the session and come with the message that brings it."""
    if len(data) < 2:
        raise WireError("short message")
    version = struct.unpack_from(">H", data)[0]
    if version == 5:
        if len(data) < 24:
            raise WireError("short header")
        return _v5(data, exporter, now)
    if version == 10:
        if len(data) < 16:
            raise WireError("short header")
        length, seconds, _, domain = struct.unpack_from(">HIII", data, 2)
        if length < 16 or length > len(data):
            raise WireError("length does not fit")
        at, end, v9 = 16, length, False
    elif version == 9:
        if len(data) < 20:
            raise WireError("short header")
        _, _, seconds, _, domain = struct.unpack_from(">HIIII", data, 2)
        at, end, v9 = 20, len(data), True
    else:
        raise WireError(f"version {version}")
    if seconds < 946684800:
        seconds = int(now)
    where, out = (*exporter, domain), []
    while at + 4 <= end:
        number, size = struct.unpack_from(">HH", data, at)
        if size < 4 or at + size > end:
            break
        body, at = data[at + 4 : at + size], at + size
        if number in ((0, 1) if v9 else (2, 3)):
            _templates(body, number in (1, 3), v9, session, where, now)
            late, session.waiting = session.waiting, []
            for when, place, wanted, text, sent in late:
                if (*place, wanted) in session.templates:
                    _emit(text, session.templates[(*place, wanted)], session, place, sent, out)
                else:
                    session.waiting.append((when, place, wanted, text, sent))
        elif number >= 256:
            template = session.templates.get((*where, number))
            if template:
                template.seen = now
                _emit(body, template, session, where, seconds, out)
            else:
                session.wait((now, where, number, body, seconds))
    return out

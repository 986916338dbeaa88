"""Column expressions over flow fields. All stay in the JVM."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, functions as F

from . import tables


def _octet(ip: Column, shift: int) -> Column:
    return F.shiftright(ip, shift).bitwiseAND(F.lit(255))


def dotted(ip: Column) -> Column:
    """IPv4 number as text; null stays null."""
    return F.concat(*[x for s in (24, 16, 8, 0) for x in (_octet(ip, s).cast("string"), F.lit("."))][:-1])


def subnet(ip: Column, prefix: int) -> Column:
    mask = 0xFFFFFFFF << (32 - prefix) & 0xFFFFFFFF
    return F.concat(dotted(ip.bitwiseAND(F.lit(mask).cast("long"))), F.lit(f"/{prefix}"))


def subnet6(ip: Column, prefix: int) -> Column:
    """IPv6 network of a 16-byte address in full hexadecimal groups."""
    h = F.lower(F.hex(ip))
    full, rest = divmod(prefix, 4)
    kept = F.substring(h, 1, full)
    if rest:
        nibble = F.conv(F.substring(h, full + 1, 1), 16, 10).cast("int").bitwiseAND(F.lit(0xF << (4 - rest) & 0xF))
        kept = F.concat(kept, F.lower(F.hex(nibble.cast("long"))))
    return F.concat(F.regexp_replace(F.rpad(kept, 32, "0"), "(....)(?=.)", "$1:"), F.lit(f"/{prefix}"))


def ipv4_in(ip: Column, text: str) -> Column:
    """Address, prefix, a-b range, or octets each *, n or n-m. Ranges are comparisons, which reach the scan."""
    if "/" in text:
        net = ipaddress.ip_network(text, strict=False)
        return ip.between(int(net[0]), int(net[-1])) if net.prefixlen else ip.isNotNull()
    parts = text.split(".")
    if len(parts) == 4 and ("*" in text or "-" in text and text.count(".") == 3):
        tests = []
        for part, shift in zip(parts, (24, 16, 8, 0), strict=True):
            if part != "*":
                lo, _, hi = part.partition("-")
                tests.append(_octet(ip, shift).between(int(lo), int(hi or lo)))
        found = ip.isNotNull()
        for t in tests:
            found = found & t
        return found
    if "-" in text:
        lo, hi = text.split("-")
        return ip.between(int(ipaddress.IPv4Address(lo)), int(ipaddress.IPv4Address(hi)))
    return ip == int(ipaddress.IPv4Address(text))


def ipv6_in(ip: Column, text: str) -> Column:
    net = ipaddress.ip_network(text, strict=False)
    lo, hi = F.lit(bytearray(net[0].packed)), F.lit(bytearray(net[-1].packed))
    return ip == lo if net.prefixlen == 128 else (ip >= lo) & (ip <= hi)


def mac_digits(mac: Column) -> Column:
    return F.lower(F.regexp_replace(mac, "[^0-9A-Fa-f]", ""))


def format_mac(mac: Column) -> Column:
    return F.regexp_replace(mac_digits(mac), "(..)(?=.)", "$1:")


def bucket(ms: Column, seconds: int) -> Column:
    return (F.floor(ms / (seconds * 1000)) * (seconds * 1000)).cast("long")


def _name(x: Column, names: dict[int, str], other: Column | None = None) -> Column:
    found = F.element_at(F.create_map(*[F.lit(v) for kv in names.items() for v in kv]), x.cast("int"))
    return F.when(x.isNotNull(), F.coalesce(found, other if other is not None else x.cast("string")))


def protocol_name(x: Column) -> Column:
    return _name(x, tables.PROTOCOL_NAMES)


def port_name(x: Column) -> Column:
    return _name(x, tables.PORT_NAMES)


def enum_name(x: Column, element: str) -> Column:
    """The name of a value of one of tables.ENUMERATIONS, or the number."""
    return _name(x, tables.ENUMERATIONS[element])


def service_class(tos: Column) -> Column:
    """A type-of-service byte as the name of its upper six bits and the byte, or the byte."""
    name = _name(F.shiftright(tos.cast("int"), 2), tables.DSCP_NAMES, F.lit(""))
    return F.when(name != "", F.concat(name, F.lit(" ("), tos.cast("string"), F.lit(")"))).otherwise(tos.cast("string"))


def flow_end_reason(x: Column) -> Column:
    return enum_name(x, "flowEndReason")


def forwarding_status(x: Column) -> Column:
    """By the lowest two bits."""
    return _name(x.cast("int").bitwiseAND(F.lit(3)), tables.FORWARDING)


def flow_direction(x: Column) -> Column:
    return enum_name(x, "flowDirection")


def firewall_event(x: Column) -> Column:
    return enum_name(x, "firewallEvent")


def tcp_flags(x: Column) -> Column:
    """Names of the lower eight bits; where none is set, three hexadecimal digits."""
    names = [F.when(x.bitwiseAND(F.lit(1 << i)) != 0, F.lit(n)) for i, n in enumerate(tables.TCP_FLAGS)]
    plain = F.lower(F.hex(x.cast("long")))
    plain = F.concat(F.lit("0x"), F.when(F.length(plain) < 3, F.lpad(plain, 3, "0")).otherwise(plain))
    return F.when(x.isNotNull(), F.when(x.bitwiseAND(F.lit(255)) == 0, plain).otherwise(F.concat_ws(",", *names)))


def icmp_type_code(x: Column, codes: bool = False) -> Column:
    """Type and code of a combined number with the type's name; codes: for unreachable destinations the code's."""
    kind, code = F.shiftright(x.cast("int"), 8).bitwiseAND(F.lit(255)), x.cast("int").bitwiseAND(F.lit(255))
    plain = F.concat(kind.cast("string"), F.lit("/"), code.cast("string"))
    name = _name(kind, tables.ICMP_TYPES, F.lit(""))
    if codes:
        name = F.when(kind == 3, _name(code, tables.ICMP_UNREACHABLE, name)).otherwise(name)
    return F.when(name != "", F.concat(name, F.lit(" ("), plain, F.lit(")"))).otherwise(plain)


def _scaled(x: Column, steps: tuple, least: Column) -> Column:
    """x over the first unit (size, digits, name) that it reaches, or least."""
    out = F.when(x.isNotNull(), least)
    for size, digits, name in reversed(steps):
        out = F.when(x >= size, F.concat(F.format_string(f"%.{digits}f", x / float(size)), F.lit(name))).otherwise(out)
    return out


def _number(x: Column) -> Column:
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def format_bytes(x: Column) -> Column:
    return _scaled(x, ((1 << 40, 2, " TB"), (1 << 30, 2, " GB"), (1 << 20, 1, " MB"), (1 << 10, 1, " KB")), F.concat(_number(x), F.lit(" B")))


def format_packets(x: Column) -> Column:
    return _scaled(x, ((10**9, 2, "G"), (10**6, 1, "M"), (10**4, 1, "K")), format_number(x))


def format_bps(x: Column) -> Column:
    return _scaled(x, ((10**12, 2, " Tbps"), (10**9, 2, " Gbps"), (10**6, 1, " Mbps"), (10**3, 1, " Kbps")), F.concat(_number(x), F.lit(" bps")))


def format_pps(x: Column) -> Column:
    return _scaled(x, ((10**9, 2, " Gpps"), (10**6, 1, " Mpps"), (10**3, 1, " Kpps")), F.concat(_number(x), F.lit(" pps")))


def format_number(x: Column) -> Column:
    """Thousands by commas; at most two digits of a fraction."""
    whole = F.format_number(x, 0)
    return F.when(x == F.floor(x), whole).otherwise(F.regexp_replace(F.format_number(x.cast("double"), 2), r"\.?0+$", ""))


def _spans(whole: Column, seconds: Column) -> list[Column]:
    """Days, hours and minutes of whole seconds, as far as there are any, then the text of the rest."""
    parts = [F.when(v > 0, F.concat(v.cast("string"), F.lit(u))) for v, u in ((F.floor(whole / 86400), "d"), (F.floor(whole / 3600) % 24, "h"), (F.floor(whole / 60) % 60, "m"))]
    return [*parts, seconds]


def format_duration(ms: Column) -> Column:
    """Milliseconds as 1d 2h 3m 4s, units that are 0 left out; below a minute with tenths of a second, if not whole."""
    whole = F.floor(ms / 1000)
    rest = F.when((whole < 60) & (ms % 1000 > 0), F.concat(F.format_string("%.1f", ms / 1000.0), F.lit("s"))).when((whole % 60 > 0) | (whole < 60), F.concat((whole % 60).cast("string"), F.lit("s")))
    return F.when(ms.isNotNull(), F.concat_ws(" ", *_spans(whole, rest)))


def format_uptime(seconds: Column) -> Column:
    """Seconds as 1d 2h 3m 4s, units that are 0 left out."""
    rest = F.when((seconds % 60 > 0) | (seconds == 0), F.concat((seconds % 60).cast("string"), F.lit("s")))
    return F.when(seconds.isNotNull(), F.concat_ws(" ", *_spans(seconds, rest)))


def format_time(x: Column) -> Column:
    """Epoch seconds (below 10**12) or milliseconds as UTC text."""
    return F.date_format(F.timestamp_millis(F.when(x < 10**12, x * 1000).otherwise(x)), "yyyy-MM-dd HH:mm:ss.SSS")


def relative_time(ms: Column, now_ms: int) -> Column:
    age = F.lit(now_ms) - ms
    out = F.concat(F.floor(age / 604_800_000).cast("string"), F.lit("w ago"))
    for top, size, unit in ((604_800_000, 86_400_000, "d"), (86_400_000, 3_600_000, "h"), (3_600_000, 60_000, "m"), (60_000, 1000, "s")):
        out = F.when(age < top, F.concat(F.floor(age / size).cast("string"), F.lit(f"{unit} ago"))).otherwise(out)
    return F.when(ms.isNotNull(), F.when(age < 0, F.lit("in the future")).when(age < 5000, F.lit("just now")).otherwise(out))


def ipv6_text(ip: Column) -> Column:
    """A 16-byte address in groups without leading zeros, the first longest run of two zero groups or more as ::."""
    groups = F.regexp_replace(F.lower(F.hex(ip)), "(....)(?=.)", "$1:")
    plain = F.regexp_replace(groups, "(?<=^|:)0+(?=[0-9a-f])", "")
    out = plain
    for k in range(2, 9):  # the longest is tested first
        run = rf"^((?:.*?[^:])?)(?::|^)0(?::0){{{k - 1}}}(?::|$)"
        out = F.when(plain.rlike(run), F.regexp_replace(plain, run, "$1::")).otherwise(out)
    return out


def format_ip(ip: Column, binary: bool = False) -> Column:
    return ipv6_text(ip) if binary else dotted(ip)


def format_cidr(ip: Column, prefix: Column, binary: bool = False) -> Column:
    """The address, with its prefix length where there is one."""
    return F.concat(format_ip(ip, binary), F.coalesce(F.concat(F.lit("/"), prefix.cast("string")), F.lit("")))


def interface_name(number: Column, name: Column, verbose: bool = False) -> Column:
    shown = F.concat(name, F.lit(" ("), number.cast("string"), F.lit(")")) if verbose else name
    return F.coalesce(shown, F.concat(F.lit("if"), number.cast("string")))


def format_asn(x: Column) -> Column:
    return F.when(x != 0, F.concat(F.lit("AS"), x.cast("string")))


def sampling_rate(x: Column) -> Column:
    return F.when(x != 0, F.concat(F.lit("1:"), x.cast("string")))


def flow_time(columns: list[str], which: str) -> Column:
    """Start or End of a flow, in ms, from the first of these that a row has: milliseconds, seconds, time since the system's start, export time."""
    c = lambda n, kind="long": F.col(n).cast(kind) if n in columns else F.lit(None).cast(kind)
    return F.coalesce(c(f"flow{which}Milliseconds"), c(f"flow{which}Seconds") * 1000, c("systemInitTimeMilliseconds") + c(f"flow{which}SysUpTime"), c("sysExportTime"))


def flow_span(columns: list[str]) -> Column:
    """A flow's duration in ms: what it says itself, or the first pair of start and end that fits."""
    c = lambda n: F.col(n).cast("long") if n in columns else F.lit(None).cast("long")
    pairs = [F.when(c(f"flowEnd{u}") >= c(f"flowStart{u}"), (c(f"flowEnd{u}") - c(f"flowStart{u}")) * k) for u, k in (("Milliseconds", 1), ("Seconds", 1000), ("SysUpTime", 1))]
    return F.coalesce(c("flowDurationMilliseconds"), c("sysFlowDuration"), *pairs)


def flow_duration(start: Column, end: Column) -> Column:
    """Not below 0, not above 32 bits."""
    return F.least(F.greatest(end - start, F.lit(0)), F.lit(0xFFFFFFFF)).cast("long")


def bits_per_second(octets: Column, ms: Column) -> Column:
    return F.try_divide(octets * 8000.0, ms.cast("double"))


def packets_per_second(packets: Column, ms: Column) -> Column:
    return F.try_divide(packets * 1000.0, ms.cast("double"))


def average_packet(octets: Column, packets: Column) -> Column:
    return F.try_divide(octets.cast("double"), packets.cast("double"))


def row_id(ms: Column, source: Column) -> Column:
    """A time-ordered 128-bit id (version 7 layout) from export time and what tells rows of a millisecond apart."""
    h = F.lower(F.md5(source.cast("string").cast("binary")))
    head = F.lpad(F.lower(F.hex(ms.cast("long"))), 12, "0")
    return F.concat(F.substring(head, 1, 8), F.lit("-"), F.substring(head, 9, 4), F.lit("-7"), F.substring(h, 1, 3), F.lit("-8"), F.substring(h, 4, 3), F.lit("-"), F.substring(h, 7, 12))


def row_id_time(row: Column) -> Column:
    return F.conv(F.regexp_replace(F.substring(row, 1, 13), "-", ""), 16, 10).cast("long")

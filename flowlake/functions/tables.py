"""Names of flow fields and values: aliases, information elements, displays."""

from __future__ import annotations

import csv

# Short names of fields.
ALIASES = {
    "src": "sourceIPv4Address", "dst": "destinationIPv4Address", "sport": "sourceTransportPort", "dport": "destinationTransportPort",
    "proto": "protocolIdentifier", "port": "sourceTransportPort", "bytes": "octetDeltaCount", "packets": "packetDeltaCount",
    "tos": "ipClassOfService", "dscp": "ipClassOfService", "flags": "tcpControlBits", "tcpflags": "tcpControlBits",
    "nexthop": "ipNextHopIPv4Address", "nexthop6": "ipNextHopIPv6Address", "bgp_nexthop": "bgpNextHopIPv4Address",
    "src_as": "bgpSourceAsNumber", "srcas": "bgpSourceAsNumber", "dst_as": "bgpDestinationAsNumber", "dstas": "bgpDestinationAsNumber",
    "vlan": "vlanId", "src_mac": "sourceMacAddress", "srcmac": "sourceMacAddress", "dst_mac": "destinationMacAddress", "dstmac": "destinationMacAddress",
    "in_if": "ingressInterface", "ingress": "ingressInterface", "out_if": "egressInterface", "egress": "egressInterface",
    "duration": "flowDurationMilliseconds", "start": "flowStartMilliseconds", "end": "flowEndMilliseconds",
    "icmp_type": "icmpTypeCodeIPv4", "icmp6_type": "icmpTypeCodeIPv6", "exporter": "sysExporterIPv4", "domain_id": "sysObservationDomainId", "app": "applicationName",
}
#: IPv6 twin of an IPv4 field.
IPV6_OF = {"sourceIPv4Address": "sourceIPv6Address", "destinationIPv4Address": "destinationIPv6Address", "ipNextHopIPv4Address": "ipNextHopIPv6Address", "bgpNextHopIPv4Address": "bgpNextHopIPv6Address"}

# Information elements that decoders know without a registry file (IANA assignments).
ELEMENTS = {
    1: ("octetDeltaCount", "u64"), 2: ("packetDeltaCount", "u64"), 3: ("deltaFlowCount", "u64"), 4: ("protocolIdentifier", "u8"), 5: ("ipClassOfService", "u8"), 6: ("tcpControlBits", "u16"), 7: ("sourceTransportPort", "u16"),
    8: ("sourceIPv4Address", "ip4"), 9: ("sourceIPv4PrefixLength", "u8"), 10: ("ingressInterface", "u32"), 11: ("destinationTransportPort", "u16"), 12: ("destinationIPv4Address", "ip4"), 13: ("destinationIPv4PrefixLength", "u8"),
    14: ("egressInterface", "u32"), 15: ("ipNextHopIPv4Address", "ip4"), 16: ("bgpSourceAsNumber", "u32"), 17: ("bgpDestinationAsNumber", "u32"), 18: ("bgpNextHopIPv4Address", "ip4"), 19: ("postMCastPacketDeltaCount", "u64"),
    20: ("postMCastOctetDeltaCount", "u64"), 21: ("flowEndSysUpTime", "u32"), 22: ("flowStartSysUpTime", "u32"), 23: ("postOctetDeltaCount", "u64"), 24: ("postPacketDeltaCount", "u64"), 25: ("minimumIpTotalLength", "u64"),
    26: ("maximumIpTotalLength", "u64"), 27: ("sourceIPv6Address", "ip6"), 28: ("destinationIPv6Address", "ip6"), 29: ("sourceIPv6PrefixLength", "u8"), 30: ("destinationIPv6PrefixLength", "u8"), 31: ("flowLabelIPv6", "u32"),
    32: ("icmpTypeCodeIPv4", "u16"), 33: ("igmpType", "u8"), 34: ("samplingInterval", "u32"), 35: ("samplingAlgorithm", "u8"), 36: ("flowActiveTimeout", "u16"), 37: ("flowIdleTimeout", "u16"), 38: ("engineType", "u8"),
    39: ("engineId", "u8"), 40: ("exportedOctetTotalCount", "u64"), 41: ("exportedMessageTotalCount", "u64"), 42: ("exportedFlowRecordTotalCount", "u64"), 44: ("sourceIPv4Prefix", "ip4"), 45: ("destinationIPv4Prefix", "ip4"),
    46: ("mplsTopLabelType", "u8"), 47: ("mplsTopLabelIPv4Address", "ip4"), 48: ("samplerId", "u16"), 52: ("minimumTTL", "u8"), 53: ("maximumTTL", "u8"), 54: ("fragmentIdentification", "u32"), 55: ("postIpClassOfService", "u8"),
    56: ("sourceMacAddress", "mac"), 57: ("postDestinationMacAddress", "mac"), 58: ("vlanId", "u16"), 59: ("postVlanId", "u16"), 60: ("ipVersion", "u8"), 61: ("flowDirection", "u8"), 62: ("ipNextHopIPv6Address", "ip6"),
    63: ("bgpNextHopIPv6Address", "ip6"), 64: ("ipv6ExtensionHeaders", "u32"), 70: ("mplsTopLabelStackSection", "oct"), 80: ("destinationMacAddress", "mac"), 81: ("postSourceMacAddress", "mac"), 82: ("interfaceName", "str"),
    83: ("interfaceDescription", "str"), 84: ("samplerName", "str"), 85: ("octetTotalCount", "u64"), 86: ("packetTotalCount", "u64"), 88: ("fragmentOffset", "u16"), 89: ("forwardingStatus", "u32"),
    90: ("mplsVpnRouteDistinguisher", "oct"), 91: ("mplsTopLabelPrefixLength", "u8"), 94: ("applicationDescription", "str"), 95: ("applicationId", "oct"), 96: ("applicationName", "str"), 98: ("postIpDiffServCodePoint", "u8"),
    128: ("bgpNextAdjacentAsNumber", "u32"), 129: ("bgpPrevAdjacentAsNumber", "u32"), 130: ("exporterIPv4Address", "ip4"), 131: ("exporterIPv6Address", "ip6"), 132: ("droppedOctetDeltaCount", "u64"),
    133: ("droppedPacketDeltaCount", "u64"), 134: ("droppedOctetTotalCount", "u64"), 135: ("droppedPacketTotalCount", "u64"), 136: ("flowEndReason", "u8"), 138: ("observationPointId", "u64"), 139: ("icmpTypeCodeIPv6", "u16"),
    140: ("mplsTopLabelIPv6Address", "ip6"), 141: ("lineCardId", "u32"), 142: ("portId", "u32"), 143: ("meteringProcessId", "u32"), 144: ("exportingProcessId", "u32"), 145: ("templateId", "u16"), 146: ("wlanChannelId", "u8"),
    147: ("wlanSSID", "str"), 148: ("flowId", "u64"), 149: ("observationDomainId", "u32"), 150: ("flowStartSeconds", "sec"), 151: ("flowEndSeconds", "sec"), 152: ("flowStartMilliseconds", "ms"), 153: ("flowEndMilliseconds", "ms"),
    154: ("flowStartMicroseconds", "u64"), 155: ("flowEndMicroseconds", "u64"), 156: ("flowStartNanoseconds", "u64"), 157: ("flowEndNanoseconds", "u64"), 158: ("flowStartDeltaMicroseconds", "u32"),
    159: ("flowEndDeltaMicroseconds", "u32"), 160: ("systemInitTimeMilliseconds", "ms"), 161: ("flowDurationMilliseconds", "u32"), 162: ("flowDurationMicroseconds", "u32"), 163: ("observedFlowTotalCount", "u64"),
    164: ("ignoredPacketTotalCount", "u64"), 165: ("ignoredOctetTotalCount", "u64"), 166: ("notSentFlowTotalCount", "u64"), 167: ("notSentPacketTotalCount", "u64"), 168: ("notSentOctetTotalCount", "u64"),
    169: ("destinationIPv6Prefix", "ip6"), 170: ("sourceIPv6Prefix", "ip6"), 171: ("postOctetTotalCount", "u64"), 172: ("postPacketTotalCount", "u64"), 173: ("flowKeyIndicator", "u64"), 176: ("icmpTypeIPv4", "u8"),
    177: ("icmpCodeIPv4", "u8"), 178: ("icmpTypeIPv6", "u8"), 179: ("icmpCodeIPv6", "u8"), 180: ("udpSourcePort", "u16"), 181: ("udpDestinationPort", "u16"), 182: ("tcpSourcePort", "u16"), 183: ("tcpDestinationPort", "u16"),
    184: ("tcpSequenceNumber", "u32"), 185: ("tcpAcknowledgementNumber", "u32"), 186: ("tcpWindowSize", "u16"), 187: ("tcpUrgentPointer", "u16"), 188: ("tcpHeaderLength", "u8"), 189: ("ipHeaderLength", "u8"),
    190: ("totalLengthIPv4", "u16"), 191: ("payloadLengthIPv6", "u16"), 192: ("ipTTL", "u8"), 193: ("nextHeaderIPv6", "u8"), 195: ("ipDiffServCodePoint", "u8"), 196: ("ipPrecedence", "u8"), 197: ("fragmentFlags", "u8"),
    200: ("mplsTopLabelTTL", "u8"), 203: ("mplsTopLabelExp", "u8"), 204: ("ipPayloadLength", "u32"), 205: ("udpMessageLength", "u16"), 206: ("isMulticast", "u8"), 208: ("ipv4Options", "u32"), 209: ("tcpOptions", "u64"),
    210: ("paddingOctets", "oct"), 211: ("collectorIPv4Address", "ip4"), 212: ("collectorIPv6Address", "ip6"), 214: ("exportProtocolVersion", "u8"), 215: ("exportTransportProtocol", "u8"), 216: ("collectorTransportPort", "u16"),
    217: ("exporterTransportPort", "u16"), 224: ("ipTotalLength", "u64"), 225: ("postNATSourceIPv4Address", "ip4"), 226: ("postNATDestinationIPv4Address", "ip4"), 227: ("postNAPTSourceTransportPort", "u16"),
    228: ("postNAPTDestinationTransportPort", "u16"), 229: ("natOriginatingAddressRealm", "u8"), 230: ("natEvent", "u8"), 231: ("initiatorOctets", "u64"), 232: ("responderOctets", "u64"), 233: ("firewallEvent", "u8"),
    234: ("ingressVRFID", "u32"), 235: ("egressVRFID", "u32"), 236: ("VRFname", "str"), 239: ("biflowDirection", "u8"), 243: ("dot1qVlanId", "u16"), 244: ("dot1qPriority", "u8"), 245: ("dot1qCustomerVlanId", "u16"),
    252: ("ingressPhysicalInterface", "u32"), 253: ("egressPhysicalInterface", "u32"), 256: ("ethernetType", "u16"), 277: ("observationPointType", "u8"), 281: ("postNATSourceIPv6Address", "ip6"),
    282: ("postNATDestinationIPv6Address", "ip6"), 286: ("anonymizationTechnique", "u16"), 297: ("natType", "u8"), 298: ("initiatorPackets", "u64"), 299: ("responderPackets", "u64"), 302: ("selectorId", "u64"),
    305: ("samplingPacketInterval", "u32"), 306: ("samplingPacketSpace", "u32"), 312: ("absoluteError", "f64"), 313: ("relativeError", "f64"), 322: ("observationTimeSeconds", "sec"), 323: ("observationTimeMilliseconds", "ms"),
    361: ("portRangeStart", "u16"), 362: ("portRangeEnd", "u16"), 371: ("userName", "str"), 459: ("httpStatusCode", "u16"), 460: ("httpRequestMethod", "str"), 461: ("httpRequestHost", "str"), 462: ("httpRequestTarget", "str"),
    468: ("dnsQueryName", "str"), 469: ("dnsQueryType", "u16"), 470: ("dnsResponseCode", "u16"),
}
_TYPES = {
    "unsigned8": "u8", "unsigned16": "u16", "unsigned32": "u32", "unsigned64": "u64", "signed8": "i8", "signed16": "i16", "signed32": "i32", "signed64": "i64", "float32": "f32", "float64": "f64",
    "boolean": "u8", "macAddress": "mac", "ipv4Address": "ip4", "ipv6Address": "ip6", "string": "str", "octetArray": "oct", "dateTimeSeconds": "sec", "dateTimeMilliseconds": "ms",
    "dateTimeMicroseconds": "u64", "dateTimeNanoseconds": "u64",
}


_ABSTRACT: dict[str, str] = {}
for _name, _kind in _TYPES.items():
    _ABSTRACT.setdefault(_kind, _name.lower())


def abstract_type(name: str, kind: str | None = None) -> str | None:
    """The element's abstract type in lower case, by its kind or name; None of an unknown name."""
    kind = kind or next((k for n, k in ELEMENTS.values() if n == name), None)
    return _ABSTRACT[kind] if kind else None


def load_registry(path: str, enterprise: int = 0) -> dict[tuple[int, int], tuple[str, str]]:
    """(enterprise, id) to (name, type) from a CSV with the columns of the public registry: ElementID, Name, Abstract Data Type. Vendors' elements come the same way."""
    with open(path, newline="", encoding="utf-8") as f:
        return {(enterprise, int(r["ElementID"])): (r["Name"], _TYPES.get(r["Abstract Data Type"], "oct")) for r in csv.DictReader(f) if r["ElementID"].isdigit() and r["Name"]}


def element(enterprise: int, number: int, registry: dict | None = None) -> tuple[str, str]:
    found = (registry or {}).get((enterprise, number)) or (ELEMENTS.get(number) if enterprise == 0 else None)
    return found or (f"pen{enterprise}.ie{number}" if enterprise else f"ie{number}", "oct")


# Fixed values of displays.
PROTOCOL_NAMES = {
    0: "HOPOPT", 1: "ICMP", 2: "IGMP", 6: "TCP", 8: "EGP", 9: "IGP", 17: "UDP", 27: "RDP", 41: "IPv6", 43: "IPv6-Route", 44: "IPv6-Frag", 46: "RSVP", 47: "GRE", 50: "ESP", 51: "AH", 58: "ICMPv6", 59: "IPv6-NoNxt", 60: "IPv6-Opts",
    88: "EIGRP", 89: "OSPF", 103: "PIM", 112: "VRRP", 132: "SCTP", 137: "MPLS-in-IP",
}
PORT_NAMES = {
    7: "Echo", 20: "FTP-Data", 21: "FTP", 22: "SSH", 23: "Telnet", 25: "SMTP", 43: "WHOIS", 53: "DNS", 67: "DHCP-S", 68: "DHCP-C", 69: "TFTP", 80: "HTTP", 88: "Kerberos", 110: "POP3", 119: "NNTP", 123: "NTP", 135: "MS-RPC", 137: "NetBIOS-NS",
    138: "NetBIOS-DGM", 139: "NetBIOS-SSN", 143: "IMAP", 161: "SNMP", 162: "SNMP-Trap", 179: "BGP", 389: "LDAP", 443: "HTTPS", 445: "SMB", 465: "SMTPS", 500: "IKE", 514: "Syslog", 520: "RIP", 546: "DHCPv6-C", 547: "DHCPv6-S", 587: "Submission",
    636: "LDAPS", 853: "DNS-TLS", 873: "Rsync", 993: "IMAPS", 995: "POP3S", 1080: "SOCKS", 1194: "OpenVPN", 1433: "MSSQL", 1521: "Oracle", 1723: "PPTP", 2049: "NFS", 2082: "cPanel", 2483: "Oracle-TLS", 3306: "MySQL", 3389: "RDP", 3478: "STUN",
    4500: "IPSec-NAT", 4739: "IPFIX", 5060: "SIP", 5061: "SIPS", 5432: "PostgreSQL", 5900: "VNC", 5938: "TeamViewer", 6379: "Redis", 6443: "K8s-API", 8080: "HTTP-Alt", 8443: "HTTPS-Alt", 8888: "HTTP-Alt2", 9090: "Prometheus",
    9200: "Elasticsearch", 9300: "ES-Transport", 27017: "MongoDB",
}
TCP_FLAGS = ("FIN", "SYN", "RST", "PSH", "ACK", "URG", "ECE", "CWR")
DSCP_NAMES = {
    0: "BE", 8: "CS1", 10: "AF11", 12: "AF12", 14: "AF13", 16: "CS2", 18: "AF21", 20: "AF22", 22: "AF23", 24: "CS3", 26: "AF31", 28: "AF32", 30: "AF33", 32: "CS4", 34: "AF41", 36: "AF42", 38: "AF43", 40: "CS5", 46: "EF", 48: "CS6", 56: "CS7",
}
ICMP_TYPES = {
    0: "Echo Reply", 3: "Dest Unreachable", 4: "Source Quench", 5: "Redirect", 8: "Echo Request", 9: "Router Advertisement", 10: "Router Solicitation", 11: "Time Exceeded", 12: "Parameter Problem", 13: "Timestamp", 14: "Timestamp Reply",
}
ICMP_UNREACHABLE = {
    0: "Net Unreachable", 1: "Host Unreachable", 2: "Protocol Unreachable", 3: "Port Unreachable", 4: "Frag Needed", 5: "Source Route Failed", 6: "Dst Net Unknown", 7: "Dst Host Unknown", 9: "Net Admin Prohib", 10: "Host Admin Prohib",
    11: "Net TOS Unreach", 12: "Host TOS Unreach", 13: "Admin Prohib",
}
#: Enumerations by the element that holds them.
ENUMERATIONS = {
    "flowEndReason": {0: "Unknown", 1: "Idle timeout", 2: "Active timeout", 3: "End of flow", 4: "Forced end", 5: "Lack of resources"},
    "natEvent": {0: "Reserved", 1: "NAT Create", 2: "NAT Delete", 3: "NAT Pool Exhausted", 4: "NAT Quota Exceeded", 5: "NAT Binding Refresh", 6: "NAT Port Alloc", 7: "NAT Port Dealloc", 8: "NAT Thresh Reached", 9: "NAT Thresh Cleared"},
    "natType": {0: "Unknown", 1: "NAT44", 2: "NAT64", 3: "NAT46", 4: "IPv4 no-NAT", 5: "NAT66", 6: "IPv6 no-NAT"},
    "flowDirection": {0: "Ingress", 1: "Egress"},
    "ipVersion": {4: "IPv4", 6: "IPv6"},
    "firewallEvent": {0: "Ignored", 1: "Flow Created", 2: "Flow Deleted", 3: "Flow Denied", 4: "Flow Alert", 5: "Flow Updated"},
    "samplingAlgorithm": {0: "Unassigned", 1: "Systematic count", 2: "Systematic time", 3: "Random n-out-of-N", 4: "Uniform probabilistic", 5: "Property match", 6: "Hash-based", 7: "Hash-based + deterministic"},
    "mplsTopLabelType": {0: "Unknown", 1: "TE-MIDPT", 2: "Pseudowire", 3: "VPN", 4: "BGP", 5: "LDP"},
    "observationPointType": {0: "Invalid", 1: "Physical port", 2: "Port channel", 3: "VLAN"},
    "natAddressRealm": {0: "Reserved", 1: "Internal", 2: "External"},
    "valueDistributionMethod": {0: "Unspecified", 1: "Start interval", 2: "End interval", 3: "Mid interval", 4: "Simple uniform"},
    "anonymizationTechnique": {0: "Undefined", 1: "None", 2: "Precision Degradation/Truncation", 3: "Binning", 4: "Enumeration", 5: "Permutation", 6: "Structured Permutation", 7: "Reverse Truncation", 8: "Noise"},
}
FORWARDING = {0: "Unknown", 1: "Forwarded", 2: "Dropped", 3: "Consumed"}

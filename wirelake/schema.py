"""The packet row, protocol numbers and tag numbers."""

from __future__ import annotations

from pyspark.sql import types as T

RAW, ETH = 0x0200, 0x0201
IP, IP6, ARP = 0x0100, 0x0101, 0x0102
ICMP, TCP, UDP, GRE, ESP, AH, ICMP6, SCTP, MPLS = 1, 6, 17, 47, 50, 51, 58, 132, 137
NVGRE, VXLAN = 0x0300, 0x0301
NONE, DATA, ANY, INVALID = 0xFF00, 0xFF01, 0xFFFE, 0xFFFF
PRID = {
    "pkt": NONE, "data": DATA, "raw": RAW, "eth": ETH, "ip": IP, "ip6": IP6, "arp": ARP, "icmp": ICMP, "tcp": TCP, "udp": UDP,
    "gre": GRE, "esp": ESP, "ah": AH, "icmp6": ICMP6, "sctp": SCTP, "mpls": MPLS, "nvgre": NVGRE, "vxlan": VXLAN,
}
NAME = {v: k for k, v in PRID.items()}
LAYER = {"eth": "link", "gre": "tunnel", "nvgre": "tunnel", "vxlan": "tunnel", "mpls": "tunnel", "ip": "net", "ip6": "net", "arp": "net", "icmp": "xport", "icmp6": "xport", "tcp": "xport", "udp": "xport"}
TAG = {"nop": 0, "timestamp": 1, "snapinfo": 2, "iniface": 3, "outiface": 4, "flow": 5, "class": 6, "seq": 7, "parseinfo": 8}

#: Error bits of a protocol data unit.
TOOSMALL, HLEN, TRUNC, CKSUM, OPTLEN, OPTERR, INVAL = 1, 2, 4, 8, 16, 32, 64

PACKET = T.StructType([
    T.StructField("pkt_no", T.LongType()),
    T.StructField("src_id", T.IntegerType()),
    T.StructField("dltype", T.IntegerType()),
    T.StructField("ts_sec", T.LongType()),
    T.StructField("ts_nsec", T.IntegerType()),
    T.StructField("wirelen", T.LongType()),
    T.StructField("in_iface", T.IntegerType()),
    T.StructField("out_iface", T.IntegerType()),
    T.StructField("flow_id", T.LongType()),
    T.StructField("class", T.LongType()),
    T.StructField("seq", T.LongType()),
    T.StructField("parseinfo", T.ArrayType(T.StructType([T.StructField("proto", T.IntegerType()), T.StructField("off", T.LongType()), T.StructField("len", T.LongType())]))),
    T.StructField("appinfo", T.ArrayType(T.StructType([T.StructField("type", T.IntegerType()), T.StructField("subtype", T.IntegerType()), T.StructField("data", T.BinaryType())]))),
    T.StructField("data", T.BinaryType()),
])

PDU = T.StructType([
    *[T.StructField(k, T.StringType() if k == "proto" else T.IntegerType()) for k in ("idx", "proto", "prid", "soff", "poff", "toff", "eoff", "error", "parent")],
    T.StructField("xoffs", T.MapType(T.StringType(), T.IntegerType())),
])
PDUS = T.ArrayType(PDU)
EMPTY_TAGS = {f.name: None for f in PACKET if f.name not in ("pkt_no", "src_id", "dltype", "data")}

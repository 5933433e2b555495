"""Packet editing: field assignment, lengths, checksums, headers put in and taken out, tunnels, generators.

Assignments to fixed places are byte splices in plain columns. What needs the nested units works on
one packet's bytes at a time (``Packet``) inside Arrow batches.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wirelake.functions.bytesx import be_bytes, be_uint, splice
from wirelake.functions.dissect import VXLAN_PORT, Unit, dissect_bytes, ones_complement, pseudo_header
from wirelake.functions.fields import unit
from wirelake.functions.registry import FIELDS
from wirelake.schema import ANY, ARP, ETH, GRE, ICMP, ICMP6, IP, IP6, MPLS, NAME, NONE, NVGRE, PACKET, PRID, TCP, UDP, VXLAN

ETHERTYPE = {IP: 0x0800, IP6: 0x86DD, ARP: 0x0806, ETH: 0x6558, MPLS: 0x8847}
INET = {IP: 4, IP6: 41, ICMP: 1, ICMP6: 58, TCP: 6, UDP: 17, GRE: 47, NVGRE: 47, MPLS: 137}
HEADERS = {
    ETH: bytes(14),
    ARP: struct.pack(">HHBBH", 1, 0x0800, 6, 4, 1) + bytes(20),
    IP: b"\x45\0\0\x14\0\0\0\0\x40" + bytes(11),
    IP6: b"\x60" + bytes(5) + b"\x3b\x40" + bytes(32),
    ICMP: b"\x08" + bytes(7),
    ICMP6: b"\x80" + bytes(7),
    TCP: bytes(12) + b"\x50" + bytes(7),
    UDP: bytes(4) + b"\0\x08" + bytes(2),
    GRE: bytes(4),
    NVGRE: b"\x20\0\x65\x58" + bytes(4),
    VXLAN: b"\x08" + bytes(7),
    MPLS: b"\0\0\x01\x40",
}

#: Where a protocol's checksum lies, and offsets that a new header of a protocol has.
CHECK_AT = {IP: 10, ICMP: 2, ICMP6: 2, TCP: 16, UDP: 6}
FRESH = {ETH: ("etype", 12), IP6: ("nxthdr", 6), ARP: ("etharp", 0)}

BOUNDS = ("soff", "poff", "toff", "eoff")
#: The numbered offsets of a unit beyond its bounds, by protocol, from number 4 on.
EXTRA = {
    "eth": ("etype", "vlan0", "vlan1"),
    "arp": ("etharp",),
    "ip": ("opt", "lsr", "ts", "rr", "srr", "ra"),
    "icmp": ("query", "pptr", "mtu", "ts", "gw", "reserved"),
    "ip6": ("nxthdr", "hopopt", "rtopt", "jlen", "fragh", "ahh", "esph", "dstopt1", "dstopt2", "unkopt", "extopt"),
    "tcp": ("opt", "mss", "wscale", "sackok", "sack", "sack_end", "tstamp", "md5"),
    "icmp6": ("eresv", "pptr", "echo", "rsol", "radv", "neigh", "redir", "ndpopt", "srclla", "srclla_eoff", "tgtlla", "tgtlla_eoff", "pfxinfo", "rdrhdr", "rdrhdr_eoff", "mtu", "radvivl", "agtinfo"),
    "gre": ("cksum", "key", "seq"),
    "mpls": ("lbl1", "lbl2", "lbl3"),
}


class Packet:
    """Mutable bytes with their units; unit 0 is the packet."""

    def __init__(self, data: bytes, dltype: int = ETH):
        self.data, self.dltype = bytearray(data), dltype
        self.parse()

    def parse(self) -> None:
        self.units: list[Unit] = dissect_bytes(bytes(self.data), self.dltype)

    def copy(self) -> Packet:
        """Another packet of the same bytes and units, which may have been moved since they were read."""
        out = Packet.__new__(Packet)
        out.data, out.dltype, out.units = bytearray(self.data), self.dltype, [replace(u, xoffs=dict(u.xoffs)) for u in self.units]
        return out

    def find(self, proto: str, nth: int = 0) -> Unit | None:
        if proto in ("pdu", "pkt"):
            return self.units[nth + (proto == "pdu")] if len(self.units) > nth + (proto == "pdu") else None
        for u in self.units[1:]:
            if u.proto == proto:
                if not nth:
                    return u
                nth -= 1
        return None

    def place(self, name: str, nth: int = 0) -> tuple[int, int, int, int]:
        """Start, bytes, first bit and bits (0: whole bytes) of a field; raises if it is absent."""
        f = FIELDS[name]
        u = self.find(f.proto, nth)
        if u is None:
            raise KeyError(name)
        start = (u.soff if f.base == "soff" else u.xoffs[f.base]) + f.off
        if f.kind == "bits":
            return start, (f.bit + f.size + 7) // 8, f.bit, f.size
        if f.kind == "var":
            return start, (u.poff if f.end == "poff" else u.xoffs[f.end]) - start, 0, 0
        return start, f.size, 0, 0

    def get(self, name: str, nth: int = 0) -> int | bytes:
        start, n, bit, bits = self.place(name, nth)
        raw = bytes(self.data[start : start + n])
        return int.from_bytes(raw, "big") >> (n * 8 - bit - bits) & ((1 << bits) - 1) if bits else raw

    def set(self, name: str, value: int | bytes, nth: int = 0) -> None:
        """Assign; numbers keep their low bits, byte strings are cut to the field."""
        start, n, bit, bits = self.place(name, nth)
        if bits:
            shift, old = n * 8 - bit - bits, int.from_bytes(self.data[start : start + n], "big")
            mask = ((1 << bits) - 1) << shift
            self.data[start : start + n] = (old & ~mask | (int(value) << shift & mask)).to_bytes(n, "big")
        elif isinstance(value, int):
            self.data[start : start + n] = (value & ((1 << 8 * n) - 1)).to_bytes(n, "big")
        else:
            part = value[:n]
            self.data[start : start + len(part)] = part

    def fix_lens(self, only: Unit | None = None) -> None:
        """Length fields from the innermost unit outwards."""
        for u in reversed(self.units[1:]) if only is None else [only]:
            s, size = u.soff, u.eoff - u.soff
            if u.prid == IP:
                self.data[s] = self.data[s] & 0xF0 | (u.poff - s) // 4
                self.data[s + 2 : s + 4] = struct.pack(">H", min(size, 65535))
            elif u.prid == IP6:
                self.data[s + 4 : s + 6] = struct.pack(">H", min(size - 40, 65535))
            elif u.prid == UDP:
                self.data[s + 4 : s + 6] = struct.pack(">H", min(size, 65535))
            elif u.prid == TCP:
                self.data[s + 12] = self.data[s + 12] & 0x0F | (u.poff - s) // 4 << 4
            elif u.prid == ARP:
                self.data[s + 4 : s + 6] = b"\x06\x04"
        if only is None:
            self.parse()

    def fix_csums(self, only: Unit | None = None) -> None:
        """Checksums from the innermost unit outwards; a UDP checksum of zero stays unused."""
        for k in range(len(self.units) - 1, 0, -1):
            u = self.units[k]
            if only is not None and u is not only:
                continue
            at, end, lead = CHECK_AT.get(u.prid), u.poff if u.prid == IP else u.toff, b""
            if u.prid == GRE and self.data[u.soff] & 0x80:
                at, end = 4, u.eoff
            if at is None or u.soff + at + 2 > len(self.data):
                continue
            if u.prid == UDP and self.data[u.soff + 6 : u.soff + 8] == b"\0\0":
                continue
            if u.prid in (TCP, UDP, ICMP6):
                net = next((x for x in reversed(self.units[:k]) if x.prid in (IP, IP6)), None)
                if net is None:
                    continue
                lead = pseudo_header(bytes(self.data), net, u.prid, end - u.soff)
            self.data[u.soff + at : u.soff + at + 2] = b"\0\0"
            value = ~ones_complement(lead, bytes(self.data[u.soff : end])) & 0xFFFF
            self.data[u.soff + at : u.soff + at + 2] = struct.pack(">H", value or (0xFFFF if u.prid == UDP else 0))
        if only is None:
            self.parse()

    def _relink(self, before: Unit, prid: int) -> None:
        """Make a unit name what now follows it."""
        s = before.soff
        if before.prid == ETH and prid in ETHERTYPE:
            at = before.xoffs.get("etype", s + 12)
            self.data[at : at + 2] = struct.pack(">H", ETHERTYPE[prid])
        elif before.prid in (GRE,) and prid in ETHERTYPE:
            self.data[s + 2 : s + 4] = struct.pack(">H", ETHERTYPE[prid])
        elif before.prid == IP and prid in INET:
            self.data[s + 9] = INET[prid]
        elif before.prid == IP6 and prid in INET:
            self.data[before.xoffs.get("nxthdr", s + 6)] = INET[prid]
        elif before.prid == UDP and prid in (VXLAN, MPLS):
            self.data[s + 2 : s + 4] = struct.pack(">H", VXLAN_PORT if prid == VXLAN else 6635)

    def insert(self, prid: int, after: int = 0) -> None:
        """Put a new header after unit ``after`` (0: outermost) and link it to its neighbours."""
        u = self.units[after]
        at, header = (u.poff if after else 0), HEADERS[prid]
        end = u.toff if after else len(self.data)
        follower = self.units[after + 1].prid if after + 1 < len(self.units) else None
        self.data[at:at] = header
        if after:
            self._relink(u, prid)
        else:
            self.dltype = prid
        n = len(header)
        fresh = Unit(prid, at, at + n, end + n, end + n, xoffs={FRESH[prid][0]: at + FRESH[prid][1]} if prid in FRESH else {})
        if follower is not None:
            self._relink(fresh, follower)
        for k, o in enumerate(self.units):
            o.toff, o.eoff = o.toff + n, o.eoff + n
            if k > after:
                o.soff, o.poff = o.soff + n, o.poff + n
                if o.xoffs:
                    o.xoffs = {x: v + n for x, v in o.xoffs.items()}
        self.units.insert(after + 1, fresh)
        for o in self.units[1 : after + 2]:
            if o.prid in (IP, IP6, UDP):
                self.fix_lens(o)

    def delete(self, index: int) -> None:
        """Take a unit's header (and trailer) out; the others stay as they were read."""
        if not 0 < index < len(self.units):
            raise IndexError(f"no unit {index}")
        u = self.units.pop(index)
        follower = self.units[index].prid if index < len(self.units) else None
        del self.data[u.toff : u.eoff]
        del self.data[u.soff : u.poff]
        if index > 1 and follower is not None:
            self._relink(self.units[index - 1], follower)
        elif index == 1:
            self.dltype = follower if follower is not None else PRID["raw"]
        n = u.poff - u.soff
        for k, o in enumerate(self.units):
            if k < index:
                o.toff, o.eoff = o.toff - n - (u.eoff - u.toff), o.eoff - n - (u.eoff - u.toff)
            else:
                o.soff, o.poff, o.toff, o.eoff, o.xoffs = o.soff - n, o.poff - n, o.toff - n, o.eoff - n, {x: v - n for x, v in o.xoffs.items()}
        for o in self.units[1:index]:
            if o.prid in (IP, IP6, UDP):
                self.fix_lens(o)

    def pop(self, n: int = 1) -> None:
        for _ in range(n):
            if len(self.units) > 1:
                self.delete(1)

    def _moved(self, to) -> None:
        for u in self.units:
            u.soff, u.poff, u.toff, u.eoff = map(to, (u.soff, u.poff, u.toff, u.eoff))
            u.xoffs = {k: to(v) for k, v in u.xoffs.items()}

    def cut_bytes(self, off: int, n: int) -> None:
        """Take bytes out; units keep their places in what is left."""
        if off < 0 or off + n > len(self.data):
            raise IndexError(f"bytes {off} to {off + n}")
        del self.data[off : off + n]
        self._moved(lambda o: o if o <= off else max(off, o - n))

    def insert_bytes(self, off: int, n: int, fill: bytes = b"\0") -> None:
        """Put bytes in; what starts or ends at off or later moves."""
        if off < 0 or off > len(self.data):
            raise IndexError(f"byte {off}")
        self.data[off:off] = fill * n
        first = self.units[0]
        self._moved(lambda o: o + n if o >= off else o)
        first.soff = first.poff = 0

    def offset(self, prid: int, nth: int, oid: int) -> tuple[Unit, str]:
        """A unit and the name of its offset number oid: 0 to 3 its bounds, from 4 on those of its protocol."""
        own = [u for k, u in enumerate(self.units) if (prid == NONE and not k) or (k and prid in (u.prid, ANY))]
        name = (*BOUNDS, *EXTRA.get(own[nth].proto if nth < len(own) else "", ()))[oid] if nth < len(own) else ""
        if not name:
            raise KeyError(f"unit {nth} of protocol {prid}")
        return own[nth], name

    def get_offset(self, prid: int, nth: int, oid: int) -> int | None:
        u, name = self.offset(prid, nth, oid)
        return getattr(u, name) if name in BOUNDS else u.xoffs.get(name)

    def adjust_offset(self, prid: int, nth: int, oid: int, amount: int) -> None:
        u, name = self.offset(prid, nth, oid)
        if name in BOUNDS:
            setattr(u, name, getattr(u, name) + amount)
        else:
            u.xoffs[name] += amount

    def vlan_push(self, vid: int, tpid: int = 0x8100) -> None:
        self.data[12:12] = struct.pack(">HH", tpid, vid & 0xFFF)
        self.parse()

    def vlan_pop(self) -> bool:
        u = self.find("eth")
        if u is None or "vlan0" not in u.xoffs:
            return False
        del self.data[u.xoffs["vlan0"] : u.xoffs["vlan0"] + 4]
        self.parse()
        return True

    def mpls_push(self, label: int, tc: int = 0, ttl: int = 64) -> None:
        u = self.find("mpls")
        if u is None:
            self.insert(MPLS, 1)
            u = self.find("mpls")
            self.data[u.soff : u.soff + 4] = struct.pack(">I", label << 12 | (tc & 7) << 9 | 0x100 | ttl)
        else:
            self.data[u.soff : u.soff] = struct.pack(">I", label << 12 | (tc & 7) << 9 | ttl)
        self.parse()

    def mpls_pop(self) -> int | None:
        """The label taken off; the last one takes the unit with it."""
        u = self.find("mpls")
        if u is None:
            return None
        word = struct.unpack_from(">I", self.data, u.soff)[0]
        if word >> 8 & 1:
            self.delete(self.units.index(u))
        else:
            del self.data[u.soff : u.soff + 4]
        self.parse()
        return word >> 12

    def finish(self) -> Packet:
        self.fix_lens()
        self.fix_csums()
        return self


def gre_encap(p: Packet, saddr: bytes = bytes(4), daddr: bytes = bytes(4), nvgre: bool = False, vsid: int = 0) -> None:
    """Wrap the frame (NVGRE) or its network packet (GRE) in IPv4 and GRE, behind the same Ethernet header."""
    macs = bytes(p.data[:12]) if p.dltype == ETH else bytes(12)
    if nvgre:
        p.insert(NVGRE)
        p.set("nvgre.vsid", vsid)
    else:
        p.pop()
        p.insert(GRE)
    p.insert(IP)
    p.set("ip.saddr", saddr)
    p.set("ip.daddr", daddr)
    p.insert(ETH)
    p.data[:12] = macs
    p.parse()
    p.fix_csums(p.units[2])


def gre_decap(p: Packet, nvgre: bool = False) -> bool:
    """Undo gre_encap; False (and no change) if the packet isn't so wrapped."""
    names = [u.proto for u in p.units[1:4]]
    if names[:1] != ["eth"] or names[1:2] not in (["ip"], ["ip6"]) or names[2:3] != ["nvgre" if nvgre else "gre"]:
        return False
    head = bytes(p.data[:12])
    p.pop(3)
    if not nvgre:
        p.insert(ETH)
        p.data[:12] = head
        p.parse()
    return True


def vxlan_encap(p: Packet, vni: int, saddr: bytes = bytes(4), daddr: bytes = bytes(4), sport: int = 49152) -> None:
    p.insert(VXLAN)
    p.set("vxlan.vsid", vni)
    p.insert(UDP)
    p.set("udp.sport", sport)
    p.set("udp.dport", VXLAN_PORT)
    p.insert(IP)
    p.set("ip.saddr", saddr)
    p.set("ip.daddr", daddr)
    p.insert(ETH)
    p.fix_csums(p.units[2])


def vxlan_decap(p: Packet) -> bool:
    if [u.proto for u in p.units[1:5]] != ["eth", "ip", "udp", "vxlan"]:
        return False
    p.pop(4)
    return True


def wrap(p: Packet, proto: str, fields: dict[str, int | bytes] | None = None) -> None:
    """A header around the packet, set from fields; lengths (IP: checksums too) are fixed as needed."""
    p.insert(PRID[proto])
    for k, v in (fields or {}).items():
        p.set(k, v)
    if proto != "tcp":
        p.fix_lens()
    if proto in ("ip", "ip6"):
        p.fix_csums()


def edit(packets: DataFrame, change, drop_errors: bool = False) -> DataFrame:
    """Apply change(packet, row) to each packet; False drops it, None and True keep it.

    row has the other columns. A missing field raises; with drop_errors the packet goes instead.
    """
    schema = packets.schema

    def fit(batches):
        for batch in batches:
            out = []
            for row in rows_of(batch):
                p = Packet(row["data"], row["dltype"])
                try:
                    stay = change(p, row)
                except (KeyError, IndexError):
                    if not drop_errors:
                        raise
                    continue
                if stay is not False:
                    out.append(row | {"data": bytes(p.data), "dltype": p.dltype})
            yield from table_of(out, schema).to_batches()

    return packets.mapInArrow(fit, schema)


def rows_of(batch: pa.RecordBatch | pa.Table) -> Iterator[dict]:
    """Rows as plain Python values, numbers exact beside nulls; tags that repeat are tuples."""
    names, columns = batch.schema.names, [c.to_pylist() if c.null_count < len(c) else [None] * len(c) for c in batch.columns]
    for k in ("parseinfo", "appinfo"):
        if k in names:
            at = names.index(k)
            columns[at] = [None if v is None else [tuple(x.values()) for x in v] for v in columns[at]]
    for values in zip(*columns, strict=True):
        yield dict(zip(names, values, strict=True))


def table_of(rows: list[dict], schema: T.StructType) -> pa.Table:
    """Rows as an Arrow table of a Spark schema."""
    kinds = to_arrow_schema(schema)
    columns = []
    for f in kinds:
        name = f.name
        values = [r.get(name) for r in rows]
        if f.name in ("parseinfo", "appinfo") and pa.types.is_list(f.type):
            inner = [x.name for x in f.type.value_type]
            values = [None if v is None else [dict(zip(inner, x, strict=True)) if not isinstance(x, dict) else x for x in v] for v in values]
        columns.append(pa.array(values, type=f.type))
    return pa.Table.from_arrays(columns, schema=kinds)


def frame_of(rows: list[dict], schema: T.StructType) -> pd.DataFrame:
    kinds = {T.LongType(): "Int64", T.IntegerType(): "Int32"}
    out = {}
    for f in schema:
        values = [r[f.name] for r in rows]
        if f.dataType in kinds:
            values = pd.array([None if v is None or v != v else int(v) for v in values], dtype=kinds[f.dataType])
        out[f.name] = values
    return pd.DataFrame(out)


def assign(packets: DataFrame, name: str, value: Column, nth: int = 0) -> DataFrame:
    """Assign a number or byte string to a field as a splice in plain columns; needs ``pdus``."""
    f = FIELDS[name]
    u = unit(f.proto, nth)
    start = (u["soff"] if f.base == "soff" else u["xoffs"][f.base]) + f.off
    if f.kind == "bits":
        n = (f.bit + f.size + 7) // 8
        shift = n * 8 - f.bit - f.size
        mask = ((1 << f.size) - 1) << shift
        old = be_uint(F.col("data"), start, n)
        new = be_bytes(old.bitwiseAND(((1 << 8 * n) - 1) ^ mask).bitwiseOR(F.shiftleft(value.cast("long"), shift).bitwiseAND(mask)), n)
    else:
        n, new = f.size, value
    made = splice(F.col("data"), start, new, n)
    return packets.withColumn("data", F.when(start.isNotNull(), made).otherwise(F.col("data")))


def make(proto: str, payload: bytes = b"", fields: dict[str, int | bytes] | None = None, v6: bool = False) -> Packet:
    """A new packet: ARP, or TCP, UDP, ICMP or ICMPv6 over IP in Ethernet, set from fields."""
    p = Packet(payload, PRID["raw"])
    for name in ([] if proto == "arp" else [proto, "ip6" if v6 or proto == "icmp6" else "ip"]):
        p.insert(PRID[name])
    if proto == "arp":
        p = Packet(HEADERS[ARP] + payload, ARP)
    p.insert(ETH)
    defaults = {"eth.src": b"\x02\0\0\0\0\x01", "eth.dst": b"\x02\0\0\0\0\x02"}
    if p.find("ip"):
        defaults |= {"ip.saddr": bytes([10, 0, 0, 1]), "ip.daddr": bytes([10, 0, 0, 2]), "ip.ttl": 64}
    for k, v in (defaults | (fields or {})).items():
        p.set(k, v)
    return p.finish()


def packet_rows(spark: SparkSession, made: list[Packet | tuple[Packet, float]]) -> DataFrame:
    """A packet table of generated packets, with timestamps where given."""
    rows = []
    for k, x in enumerate(made, 1):
        p, at = x if isinstance(x, tuple) else (x, None)
        rows.append((k, 0, p.dltype, None if at is None else int(at), None if at is None else int(round(at % 1 * 1e9)), *[None] * 8, bytes(p.data)))
    return spark.createDataFrame(rows, PACKET)


def tcp_session(client: list[bytes] | bytes, server: list[bytes] | bytes, mss: int = 1460, max_window: int = 65535, handshake: bool = True, close: bool = True,
                caddr: bytes = bytes([10, 0, 0, 1]), saddr: bytes = bytes([10, 0, 0, 2]), cport: int = 10000, sport: int = 80, cseq: int = 1000, sseq: int = 5000) -> list[Packet]:
    """A TCP conversation: the parties' messages in turn, cut to segments, acknowledged by windows that double."""
    seq, window, out = {0: cseq, 1: sseq}, {0: mss * 2, 1: mss * 2}, []

    def send(side: int, body: bytes = b"", **flags: int) -> None:
        ends = {"ip.saddr": (caddr, saddr)[side], "ip.daddr": (saddr, caddr)[side], "tcp.sport": (cport, sport)[side], "tcp.dport": (sport, cport)[side]}
        numbers = {"tcp.seqn": seq[side], "tcp.ackn": seq[1 - side] if flags.get("ack") else 0, "tcp.win": 65535}
        out.append(make("tcp", body, ends | numbers | {f"tcp.{k}": v for k, v in flags.items()}))
        seq[side] = (seq[side] + len(body) + flags.get("syn", 0) + flags.get("fin", 0)) & 0xFFFFFFFF

    if handshake:
        send(0, syn=1)
        send(1, syn=1, ack=1)
        send(0, ack=1)
    turns = [client] if isinstance(client, bytes) else list(client)
    answers = [server] if isinstance(server, bytes) else list(server)
    for k in range(max(len(turns), len(answers))):
        for side, said in ((0, turns), (1, answers)):
            body, sent = said[k] if k < len(said) else b"", 0
            for at in range(0, len(body), mss):
                part = body[at : at + mss]
                send(side, part, ack=1, psh=int(at + mss >= len(body)))
                sent += len(part)
                if sent >= window[side] or at + mss >= len(body):
                    send(1 - side, ack=1)
                    sent, window[side] = 0, min(max_window, window[side] * 2)
    if close:
        send(0, fin=1, ack=1)
        send(1, fin=1, ack=1)
        send(0, ack=1)
    return out


def names_of(p: Packet) -> list[str]:
    return [NAME.get(u.prid, u.proto) for u in p.units[1:]]



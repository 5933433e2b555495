"""Dissection of packet bytes into nested protocol data units.

Each parser takes (buffer, start, end) and returns a unit and what comes next; ``dissect_bytes`` runs
them from the outermost protocol on. ``with_pdus`` applies it in Arrow batches. For queries that only
need Ethernet (at most two tags), IPv4 and TCP, UDP or ICMP headers, ``with_headers`` gives the same
offsets as plain columns, which stay in generated code and let the scan prune.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wirelake.functions.bytesx import be_uint, bits
from wirelake.schema import ARP, CKSUM, ETH, GRE, HLEN, ICMP, ICMP6, INVAL, IP, IP6, MPLS, NAME, NVGRE, OPTERR, OPTLEN, PDU, PDUS, RAW, TCP, TOOSMALL, TRUNC, UDP, VXLAN

VLAN_TYPES = (0x8100, 0x88A8)
BY_ETHERTYPE = {0x0800: IP, 0x86DD: IP6, 0x0806: ARP, 0x6558: ETH, 0x8847: MPLS, 0x8848: MPLS}
VXLAN_PORT, MPLS_PORT = 4789, 6635
EXTENSIONS = {0, 43, 44, 60, 135}


@dataclass(slots=True)
class Unit:
    prid: int
    soff: int
    poff: int
    toff: int
    eoff: int
    error: int = 0
    parent: int = 0
    xoffs: dict[str, int] = field(default_factory=dict)
    next: int | None = None
    next_span: tuple[int, int] | None = None

    @property
    def proto(self) -> str:
        return NAME.get(self.prid) or f"inet{self.prid}"


def ones_complement(*parts: bytes) -> int:
    """Folded 16-bit sum of the parts, taken as one string."""
    data = b"".join(parts)
    total = int.from_bytes(data, "big") << (8 if len(data) % 2 else 0)
    return total % 0xFFFF or (0xFFFF if total else 0)


def pseudo_header(buf: bytes, net: Unit, proto: int, length: int) -> bytes:
    if net.prid == IP:
        return buf[net.soff + 12 : net.soff + 20] + struct.pack(">BBH", 0, proto, length)
    return buf[net.soff + 8 : net.soff + 40] + struct.pack(">II", length, proto)


def _short(prid: int, s: int, e: int) -> Unit:
    return Unit(prid, s, e, e, e, TOOSMALL)


def _eth(buf, s, e, up):
    if e - s < 14:
        return _short(ETH, s, e)
    at, x, tags = s + 12, {}, 0
    while at + 2 <= e and int.from_bytes(buf[at : at + 2], "big") in VLAN_TYPES:
        if at + 6 > e:
            return Unit(ETH, s, e, e, e, HLEN, xoffs=x)
        if tags < 2:
            x[f"vlan{tags}"] = at
        tags, at = tags + 1, at + 4
    x["etype"] = at
    kind = int.from_bytes(buf[at : at + 2], "big")
    return Unit(ETH, s, at + 2, e, e, xoffs=x, next=BY_ETHERTYPE.get(kind))


def _arp(buf, s, e, up):
    if e - s < 8:
        return _short(ARP, s, e)
    hw, pr, hl, pl = struct.unpack_from(">HHBB", buf, s)
    n = 8 + 2 * (hl + pl)
    x = {"etharp": s} if (hw, pr, hl, pl) == (1, 0x0800, 6, 4) and e - s >= 28 else {}
    return Unit(ARP, s, min(s + n, e), min(s + n, e), e, HLEN if s + n > e else 0, xoffs=x)


def _ip_options(buf, at, end, unit):
    seen = {131: "lsr", 68: "ts", 7: "rr", 137: "srr", 148: "ra"}
    while at < end:
        kind = buf[at]
        if kind == 0:
            break
        if kind == 1:
            at += 1
            continue
        n = buf[at + 1] if at + 1 < end else 0
        if n < 2 or at + n > end:
            unit.error |= OPTLEN
            return
        if kind in seen:
            if seen[kind] in unit.xoffs:
                unit.error |= OPTERR
            unit.xoffs.setdefault(seen[kind], at)
        at += n


def _ip(buf, s, e, up):
    if e - s < 20:
        return _short(IP, s, e)
    version, ihl = buf[s] >> 4, (buf[s] & 15) * 4
    total, frag = struct.unpack_from(">H", buf, s + 2)[0], struct.unpack_from(">H", buf, s + 6)[0]
    if version != 4 or ihl < 20 or s + ihl > e:
        return Unit(IP, s, e, e, e, HLEN)
    u = Unit(IP, s, s + ihl, e, e)
    if ones_complement(buf[s : s + ihl]) != 0xFFFF:
        u.error |= CKSUM
    if total < ihl or s + total > e:
        u.error |= TRUNC
    else:
        u.toff = s + total
    off = (frag & 0x1FFF) * 8
    if off and off + total - ihl > 65535:
        u.error |= INVAL
    if ihl > 20:
        u.xoffs["opt"] = s + 20
        _ip_options(buf, s + 20, s + ihl, u)
    if not off:
        u.next = {4: IP, 41: IP6}.get(buf[s + 9], buf[s + 9])
    return u


def _ip6(buf, s, e, up):
    if e - s < 40:
        return _short(IP6, s, e)
    if buf[s] >> 4 != 6:
        return Unit(IP6, s, e, e, e, HLEN)
    total, nxt, at = struct.unpack_from(">H", buf, s + 4)[0], buf[s + 6], s + 40
    u = Unit(IP6, s, at, e, e, xoffs={"nxthdr": s + 6})
    first = True
    while nxt in EXTENSIONS:
        if at + 8 > e:
            u.error |= OPTLEN
            break
        n = 8 if nxt == 44 else 8 + buf[at + 1] * 8
        if at + n > e:
            u.error |= OPTLEN
            break
        u.xoffs.setdefault({0: "hopopt", 43: "rtopt", 44: "fragh", 60: "dstopt1" if first else "dstopt2"}.get(nxt, "extopt"), at)
        if nxt == 0 and total == 0 and n >= 8 and buf[at + 2] == 0xC2:
            u.xoffs["jlen"], total = at + 4, struct.unpack_from(">I", buf, at + 4)[0]
        first = first and nxt not in (43,)
        u.xoffs["nxthdr"] = at
        offset = struct.unpack_from(">H", buf, at + 2)[0] >> 3 if nxt == 44 else 0
        nxt, at = buf[at], at + n
        if offset:
            nxt = None
            break
    u.poff = at
    if s + 40 + total > e:
        u.error |= TRUNC
    else:
        u.toff = max(at, s + 40 + total)
    u.next = None if nxt in (None, 59) else {4: IP, 41: IP6}.get(nxt, nxt)
    return u


def _checked(buf, u, up, proto):
    if up is not None and up.prid in (IP, IP6) and ones_complement(pseudo_header(buf, up, proto, u.eoff - u.soff), buf[u.soff : u.eoff]) != 0xFFFF:
        u.error |= CKSUM
    return u


def _icmp(buf, s, e, up):
    if e - s < 8:
        return _short(ICMP, s, e)
    kind, code = buf[s], buf[s + 1]
    u = Unit(ICMP, s, s + 8, e, e)
    if ones_complement(buf[s:e]) != 0xFFFF:
        u.error |= CKSUM
    if kind in (0, 8, 13, 14, 15, 16, 17, 18):
        u.xoffs["query"] = s + 4
        if kind in (13, 14) and e - s >= 20:
            u.xoffs["ts"], u.poff = s + 8, s + 20
    elif kind == 3 and code == 4:
        u.xoffs["mtu"] = s + 4
    elif kind == 5:
        u.xoffs["gw"] = s + 4
    elif kind == 12:
        u.xoffs["pptr"] = s + 4
    elif kind in (3, 4, 11):
        u.xoffs["reserved"] = s + 4
    if kind in (3, 4, 5, 11, 12):
        u.next = IP
    return u


def _nd_options(buf, at, e, u):
    names = {1: "srclla", 2: "tgtlla", 3: "pfxinfo", 4: "rdrhdr", 5: "mtu", 7: "radvivl", 8: "agtinfo"}
    if at < e:
        u.xoffs["ndpopt"] = at
    while at + 2 <= e:
        n = buf[at + 1] * 8
        if not n or at + n > e:
            u.error |= OPTLEN
            return
        if name := names.get(buf[at]):
            u.xoffs.setdefault(name, at)
            if name in ("srclla", "tgtlla", "rdrhdr"):
                u.xoffs.setdefault(f"{name}_eoff", at + n)
        at += n


def _icmp6(buf, s, e, up):
    if e - s < 8:
        return _short(ICMP6, s, e)
    kind = buf[s]
    u = _checked(buf, Unit(ICMP6, s, s + 8, e, e), up, ICMP6)
    if kind in (1, 2, 3, 4):
        u.xoffs["pptr" if kind in (2, 4) else "eresv"] = s + 4
        u.next = IP6
    elif kind in (128, 129):
        u.xoffs["echo"] = s + 4
    elif kind in (133, 134, 135, 136, 137):
        name, n = {133: ("rsol", 4), 134: ("radv", 12), 135: ("neigh", 20), 136: ("neigh", 20), 137: ("redir", 36)}[kind]
        if s + 4 + n > e:
            u.error |= HLEN
        else:
            u.xoffs[name] = s + 4
            _nd_options(buf, s + 4 + n, e, u)
            u.poff = e
    return u


def _udp(buf, s, e, up):
    if e - s < 8:
        return _short(UDP, s, e)
    dport, n, check = struct.unpack_from(">HHH", buf, s + 2)
    u = Unit(UDP, s, s + 8, e, e)
    if n < 8 or s + n > e:
        u.error |= TRUNC
    else:
        u.toff = s + n
    if check and not u.error:
        span = Unit(UDP, s, s + 8, u.toff, u.toff)
        u.error |= _checked(buf, span, up, UDP).error
    if dport == VXLAN_PORT and e - s >= 16 and buf[s + 8] & 8:
        u.next = VXLAN
    elif dport == MPLS_PORT:
        u.next = MPLS
    return u


def _tcp(buf, s, e, up):
    if e - s < 20:
        return _short(TCP, s, e)
    n = (buf[s + 12] >> 4) * 4
    if n < 20 or s + n > e:
        return Unit(TCP, s, e, e, e, HLEN)
    u = _checked(buf, Unit(TCP, s, s + n, e, e), up, TCP)
    if n > 20:
        u.xoffs["opt"], at = s + 20, s + 20
        names = {2: ("mss", 4), 3: ("wscale", 3), 4: ("sackok", 2), 5: ("sack", None), 8: ("tstamp", 10), 19: ("md5", 18)}
        while at < s + n and buf[at]:
            if buf[at] == 1:
                at += 1
                continue
            size = buf[at + 1] if at + 1 < s + n else 0
            if size < 2 or at + size > s + n:
                u.error |= OPTLEN
                break
            if buf[at] in names:
                name, want = names[buf[at]]
                if want not in (None, size):
                    u.error |= OPTERR
                elif name in u.xoffs:
                    u.error |= OPTERR
                else:
                    u.xoffs[name] = at
                    if name == "sack":
                        u.xoffs["sack_end"] = at + size
            at += size
    return u


def _gre(buf, s, e, up):
    if e - s < 4:
        return _short(GRE, s, e)
    flags, kind = buf[s], int.from_bytes(buf[s + 2 : s + 4], "big")
    nv = kind == 0x6558 and buf[s + 1] & 7 == 0 and flags & 0xF0 == 0x20
    at, x = s + 4, {}
    for bit, name in ((0x80, "cksum"), (0x20, "key"), (0x10, "seq")):
        if flags & bit or (name == "cksum" and flags & 0x40):
            x[name], at = at, at + 4
    if at > e:
        return Unit(GRE, s, e, e, e, HLEN)
    u = Unit(NVGRE if nv else GRE, s, at, e, e, xoffs={} if nv else x, next=BY_ETHERTYPE.get(kind))
    if flags & 0x80 and ones_complement(buf[s:e]) != 0xFFFF:
        u.error |= CKSUM
    return u


def _vxlan(buf, s, e, up):
    if e - s < 8:
        return _short(VXLAN, s, e)
    return Unit(VXLAN, s, s + 8, e, e, next=ETH if e - s >= 22 else None)


def _mpls(buf, s, e, up):
    at, x, labels = s, {}, 0
    while True:
        if at + 4 > e:
            return Unit(MPLS, s, e, e, e, HLEN, xoffs=x) if labels else _short(MPLS, s, e)
        if 0 < labels < 4:
            x[f"lbl{labels}"] = at
        labels, at = labels + 1, at + 4
        if buf[at - 2] & 1:
            break
    u = Unit(MPLS, s, at, e, e, xoffs=x)
    if at < e:
        u.next = {4: IP, 6: IP6}.get(buf[at] >> 4)
    return u


PARSERS = {ETH: _eth, ARP: _arp, IP: _ip, IP6: _ip6, ICMP: _icmp, ICMP6: _icmp6, UDP: _udp, TCP: _tcp, GRE: _gre, NVGRE: _gre, VXLAN: _vxlan, MPLS: _mpls}


def add_parser(prid: int, parser, ethertype: int | None = None) -> None:
    """Plug in a protocol: parser(buf, start, end, enclosing unit) returns a Unit."""
    PARSERS[prid] = parser
    if ethertype is not None:
        BY_ETHERTYPE[ethertype] = prid


def dissect_bytes(buf: bytes, dltype: int) -> list[Unit]:
    """Units in order; the first is the packet itself."""
    out = [Unit(0xFF00, 0, 0, len(buf), len(buf))]
    prid, s, e, parent, net = (None if dltype == RAW else dltype), 0, len(buf), 0, None
    while prid in PARSERS and s < e:
        u = PARSERS[prid](buf, s, e, net)
        u.parent = parent
        out.append(u)
        if u.prid in (IP, IP6):
            net = u
        if u.error & (TOOSMALL | HLEN):
            break
        prid, s, e, parent = u.next, u.poff, u.toff, len(out) - 1
    return out


def as_rows(units: list[Unit]) -> list[dict]:
    return [{"idx": k, "proto": "pkt" if not k else u.proto, "prid": u.prid, "soff": u.soff, "poff": u.poff, "toff": u.toff, "eoff": u.eoff, "error": u.error, "parent": u.parent, "xoffs": u.xoffs} for k, u in enumerate(units)]


FIELDS_OF_UNITS = ("idx", "prid", "soff", "poff", "toff", "eoff", "error", "parent")
#: Bytes whose sums are held at once.
SUMMED = 1 << 22


def _words(buf: np.ndarray) -> Callable:
    """sum16(start, end): the sums of big-endian 16-bit words of spans of the bytes, an odd last byte padded with zero."""
    high = np.zeros(len(buf) + 1, np.uint32)
    low = np.zeros(len(buf) + 1, np.uint32)
    high[1::2], low[2::2] = buf[0::2], buf[1::2]
    np.cumsum(high, out=high, dtype=np.uint32)
    np.cumsum(low, out=low, dtype=np.uint32)

    def sum16(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = (high[b] - high[a]).astype(np.int64), (low[b] - low[a]).astype(np.int64)
        return np.where(a % 2 == 0, x * 256 + y, y * 256 + x)

    return sum16


def _wrong(total: np.ndarray) -> np.ndarray:
    """CKSUM where the folded sum isn't all ones."""
    return np.where((total % 0xFFFF == 0) & (total > 0), 0, CKSUM).astype(np.int32)


def _common(buf: np.ndarray, at: np.ndarray, size: np.ndarray, dltype: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Which packets are Ethernet, IPv4 and TCP, UDP or echo of the plainest form, and what their units need.

    ``at`` is where each packet starts in ``buf``. All others are left to the parsers.
    """
    pick = np.flatnonzero((dltype == ETH) & (size >= 42))
    byte = lambda p, k: buf[p + k].astype(np.int64)
    two = lambda p, k: byte(p, k) << 8 | byte(p, k + 1)

    def left(test: np.ndarray) -> None:
        nonlocal pick
        pick = pick[test]

    left((two(at[pick], 12) == 0x0800) & (byte(at[pick], 14) == 0x45) & (two(at[pick], 20) & 0x1FFF == 0))
    total, proto = two(at[pick], 16), byte(at[pick], 23)
    left((total + 14 <= size[pick]) & (((proto == TCP) & (total >= 40)) | (((proto == UDP) | (proto == ICMP)) & (total >= 28))))
    total, proto, p = two(at[pick], 16), byte(at[pick], 23), at[pick]
    udp, dport, kind = two(p, 38), two(p, 36), byte(p, 34)
    plain = (proto == TCP) & (byte(p, np.where(proto == TCP, 46, 34)) >> 4 == 5)
    plain |= (proto == UDP) & (udp >= 8) & (udp <= total - 20) & (dport != VXLAN_PORT) & (dport != MPLS_PORT)
    plain |= (proto == ICMP) & ((kind == 0) | (kind == 8))
    left(plain)
    total, proto, p = total[plain], proto[plain], p[plain]
    end = 14 + total
    toff = np.where(proto == UDP, 34 + udp[plain], end)
    sum16 = _words(buf)
    ends = sum16(p + 26, p + 34) + proto + toff - 34
    wrong = _wrong(sum16(p + 34, p + np.where(proto == UDP, toff, end)) + np.where(proto == ICMP, 0, ends))
    unused = (proto == UDP) & (two(p, 40) == 0)
    return pick, {"end": end, "toff": toff, "proto": proto, "ip": _wrong(sum16(p + 14, p + 34)), "wrong": np.where(unused, 0, wrong), "poff": np.where(proto == TCP, 54, 42)}


def _units(data: pa.Array, dltype: pa.Array) -> pa.Array:
    """The rows of ``dissect_bytes`` for a column of packets: common packets by arithmetic over all of them at once."""
    n = len(data)
    data = data.cast(pa.large_binary())
    _, bounds, body = data.buffers()
    bounds = np.frombuffer(bounds, np.int64)[data.offset : data.offset + n + 1] if n else np.zeros(1, np.int64)
    buf = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    size = np.diff(bounds)
    there = data.is_valid().to_numpy(zero_copy_only=False)
    kinds = dltype.fill_null(-1).to_numpy(zero_copy_only=False)
    fast, parts, a = [], [], 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + SUMMED, "right")) - 1)
        b = min(b, n)
        span = buf[bounds[a] : bounds[b]]
        pick, got = _common(span, bounds[a:b] - bounds[a], np.where(there[a:b], size[a:b], 0), kinds[a:b])
        fast.append(pick + a)
        parts.append(got)
        a = b
    fast = np.concatenate(fast) if fast else np.zeros(0, np.int64)
    of = {k: np.concatenate([x[k] for x in parts]) for k in parts[0]} if parts else {}
    slow = there.copy()
    slow[fast] = False
    rest = {int(k): dissect_bytes(buf[bounds[k] : bounds[k + 1]].tobytes(), int(kinds[k])) for k in np.flatnonzero(slow)}
    counts = np.zeros(n + 1, np.int64)
    counts[fast + 1] = 4
    for k, us in rest.items():
        counts[k + 1] = len(us)
    starts = np.cumsum(counts)
    whole = int(starts[-1])
    f = {k: np.zeros(whole, np.int32) for k in FIELDS_OF_UNITS}
    names = ["pkt", "eth", "ip", "tcp", "udp", "icmp"]
    code = {k: i for i, k in enumerate(names)}
    proto, n_offs = np.zeros(whole, np.int32), np.zeros(whole, np.int64)
    if len(fast):
        at, e, x = starts[fast], size[fast], of["proto"]
        icmp = x == ICMP
        rows = [(0, 0xFF00, 0, 0, e, e, 0, 0, 0), (1, ETH, 0, 14, e, e, 0, 0, 1), (2, IP, 14, 34, of["end"], e, of["ip"], 1, 2)]
        rows.append((3, x, 34, of["poff"], of["toff"], of["end"], of["wrong"], 2, np.where(x == TCP, code["tcp"], np.where(icmp, code["icmp"], code["udp"]))))
        for j, row in enumerate(rows):
            for k, v in zip(FIELDS_OF_UNITS, row, strict=False):
                f[k][at + j] = v
            proto[at + j] = row[-1]
        n_offs[at + 1], n_offs[at + 3] = 1, icmp
    for k, us in rest.items():
        for j, u in enumerate(us, int(starts[k])):
            f["idx"][j], f["prid"][j], f["soff"][j], f["poff"][j], f["toff"][j], f["eoff"][j], f["error"][j], f["parent"][j] = j - int(starts[k]), u.prid, u.soff, u.poff, u.toff, u.eoff, u.error, u.parent
            name = u.proto if j > starts[k] else "pkt"
            proto[j] = code.setdefault(name, len(code))
            n_offs[j] = len(u.xoffs)
    off_at = np.concatenate([[0], np.cumsum(n_offs)])
    words = ["etype", "query"]
    word, value, known = np.zeros(int(off_at[-1]), np.int32), np.zeros(int(off_at[-1]), np.int32), {k: i for i, k in enumerate(words)}
    if len(fast):
        value[off_at[at + 1]] = 12
        q = off_at[at[icmp] + 3]
        word[q], value[q] = 1, 38
    for k, us in rest.items():
        for j, u in enumerate(us, int(starts[k])):
            for i, (name, v) in enumerate(u.xoffs.items(), int(off_at[j])):
                word[i], value[i] = known.setdefault(name, len(known)), v
    offs = pa.MapArray.from_arrays(pa.array(off_at, pa.int32()), pa.array(list(known), pa.string()).take(pa.array(word)), pa.array(value))
    columns = {k: pa.array(v) for k, v in f.items()} | {"proto": pa.array(list(code), pa.string()).take(pa.array(proto)), "xoffs": offs}
    kind = to_arrow_type(PDU)
    units = pa.StructArray.from_arrays([columns[x.name].cast(x.type) for x in kind], fields=list(kind))
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), units)


def with_pdus(packets: DataFrame) -> DataFrame:
    """Add ``pdus``."""
    return packets.withColumn("pdus", F.arrow_udf(_units, PDUS)("data", "dltype"))


def with_headers(packets: DataFrame) -> DataFrame:
    """Add h_net, h_ip, h_tcp ...: offsets of the common headers as columns; null where a header is absent.

    Only for Ethernet, up to two tags, IPv4 without fragment offset, TCP, UDP and ICMP.
    """
    d = F.col("data")
    e0, e1 = be_uint(d, 12, 2), be_uint(d, 16, 2)
    tags = F.when(e0.isin(*VLAN_TYPES), F.when(e1.isin(*VLAN_TYPES), 2).otherwise(1)).otherwise(0)
    rows = fixed(packets, h_net=F.when((F.col("dltype") == ETH) & (F.length(d) >= 14), F.lit(14) + 4 * tags))
    rows = fixed(rows, h_ethtype=be_uint(d, F.col("h_net") - 2, 2).cast("int"))
    ip = F.when((F.col("h_ethtype") == 0x0800) & (F.length(d) >= F.col("h_net") + 20), F.col("h_net"))
    rows = fixed(rows, h_ip=ip)
    ip = F.col("h_ip")
    rows = fixed(rows, h_ip_proto=be_uint(d, ip + 9, 1).cast("int"), h_first=F.when(bits(d, ip + 6, 3, 13) == 0, ip + 4 * bits(d, ip, 4, 4)).cast("int"))
    is_proto = {"h_tcp": TCP, "h_udp": UDP, "h_icmp": ICMP}
    return fixed(rows, **{k: F.when(F.col("h_ip_proto") == v, F.col("h_first")) for k, v in is_proto.items()}).drop("h_first")


def fixed(rows: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that the optimizer takes as they are: predicates on them don't pull their expressions in again."""
    one = F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()])))
    return rows.select("*", one.alias("__s")).select(*rows.columns, *[F.col(f"__s.{k}").alias(k) for k in columns])


def header_uint(header: str, off: int, n: int) -> Column:
    """A number in a header found by ``with_headers``."""
    return be_uint(F.col("data"), F.col(f"h_{header}") + off, n)

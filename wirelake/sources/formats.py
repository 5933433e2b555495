"""Packet formats as bytes: XPKT records, PCAP files, hex text."""

from __future__ import annotations

import re
import struct
from functools import lru_cache

from wirelake.functions.dissect import dissect_bytes
from wirelake.functions.registry import FIELDS
from wirelake.schema import EMPTY_TAGS, ETH, NAME, PACKET

MAGICS = {b"\xa1\xb2\xc3\xd4": (">", 1000), b"\xd4\xc3\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1)}


#: The columns of each type of tag; those of 128 and more are in appinfo.
TAG_COLUMNS = {1: ("ts_sec", "ts_nsec"), 2: ("wirelen",), 3: ("in_iface",), 4: ("out_iface",), 5: ("flow_id",), 6: ("class",), 7: ("seq",), 8: ("parseinfo",)}


def signed64(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def put_tag(row: dict, raw: bytes, at: int | None = None) -> None:
    """Set the columns that a tag's bytes stand for; repeatable tags are added, or replace number ``at``."""
    kind, _, half = struct.unpack_from(">BBH", raw)
    body = raw[4:]
    if kind == 1:
        row["ts_sec"], row["ts_nsec"] = struct.unpack(">II", body)
    elif kind == 2:
        row["wirelen"] = struct.unpack(">I", body)[0]
    elif kind in (3, 4):
        row["in_iface" if kind == 3 else "out_iface"] = half
    elif kind in (5, 6, 7):
        row[("flow_id", "class", "seq")[kind - 5]] = signed64(struct.unpack(">Q", body)[0])
    elif kind == 8 or kind >= 128:
        name, own = ("parseinfo", (half, *struct.unpack(">II", body))) if kind == 8 else ("appinfo", (kind, half, body))
        have = list(row.get(name) or [])
        row[name] = [*have[:at], own, *have[at + 1 :]] if at is not None else [*have, own]


def tag(kind: int, half: int = 0, body: bytes = b"") -> bytes:
    return struct.pack(">BBH", kind, len(body) // 4, half) + body


def tags(row: dict, only: int | None = None) -> list[bytes]:
    """The tags of a packet's columns (of one type, if given), each with its four leading bytes."""
    out = []
    if only is not None:
        row = {k: row.get(k) for k in TAG_COLUMNS.get(only, ("appinfo",) if only >= 128 else ())}
        if row.get("appinfo"):
            row["appinfo"] = [x for x in row["appinfo"] if x[0] == only]
    if row.get("ts_sec") is not None:
        out.append(tag(1, 0, struct.pack(">II", row["ts_sec"] & 0xFFFFFFFF, row.get("ts_nsec") or 0)))
    if row.get("wirelen") is not None:
        out.append(tag(2, 0, struct.pack(">I", row["wirelen"])))
    for kind, name in ((3, "in_iface"), (4, "out_iface")):
        if row.get(name) is not None:
            out.append(tag(kind, row[name] & 0xFFFF))
    for kind, name in ((5, "flow_id"), (6, "class"), (7, "seq")):
        if row.get(name) is not None:
            out.append(tag(kind, 0, struct.pack(">Q", row[name] & 0xFFFFFFFFFFFFFFFF)))
    for proto, off, length in row.get("parseinfo") or []:
        out.append(tag(8, proto, struct.pack(">II", off, length)))
    for kind, sub, body in row.get("appinfo") or []:
        out.append(tag(kind, sub, bytes(body) + bytes(-len(body) % 4)))
    return out


def read_xpkt(data: bytes):
    """Yield a packet's columns for each record; raises on a malformed one."""
    at, n = 0, 0
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError("record cut short")
        size, dltype, words = struct.unpack_from(">IHH", data, at)
        if size < 8 or words * 4 > size - 8 or at + size > len(data):
            raise ValueError(f"bad record at {at}")
        n += 1
        row = EMPTY_TAGS | {"pkt_no": n, "src_id": 0, "dltype": dltype, "parseinfo": None, "appinfo": None}
        t, end, seen = at + 8, at + 8 + words * 4, set()
        while t < end:
            kind, nw = data[t], data[t + 1]
            if t + 4 + nw * 4 > end or kind == 127:
                raise ValueError(f"bad tag {kind} at {t}")
            if 0 < kind < 8 and kind in seen:
                raise ValueError(f"tag {kind} twice at {t}")
            seen.add(kind)
            put_tag(row, data[t : t + 4 + nw * 4])
            t += 4 + nw * 4
        row["data"] = data[end : at + size]
        yield row
        at += size


def write_xpkt(row: dict) -> bytes:
    """One record of a packet's columns."""

    out = b"".join(tags(row))
    return struct.pack(">IHH", 8 + len(out) + len(row["data"]), row["dltype"], len(out) // 4) + out + bytes(row["data"])


def read_pcap(data: bytes, iface: int = 0):
    """Yield packets of an Ethernet capture; the captured length comes first in a record, as the format says."""
    if data[:4] not in MAGICS:
        raise ValueError("not a PCAP file")
    order, unit = MAGICS[data[:4]]
    if struct.unpack_from(order + "I", data, 20)[0] != 1:
        raise ValueError("only Ethernet captures are read")
    at, n = 24, 0
    while at + 16 <= len(data):
        sec, frac, kept, size = struct.unpack_from(order + "IIII", data, at)
        n += 1
        yield EMPTY_TAGS | {"pkt_no": n, "src_id": 0, "dltype": ETH, "ts_sec": sec, "ts_nsec": frac * unit, "in_iface": iface, "wirelen": size if size != kept else None, "data": data[at + 16 : at + 16 + kept]}
        at += 16 + kept


def pcap_start() -> bytes:
    return struct.pack(">IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65536, 1)


def write_pcap(row: dict) -> bytes:
    if row["dltype"] != ETH:
        raise ValueError("PCAP files are written of Ethernet packets only")
    return struct.pack(">IIII", (row.get("ts_sec") or 0) & 0xFFFFFFFF, (row.get("ts_nsec") or 0) // 1000, len(row["data"]), row.get("wirelen") or len(row["data"])) + bytes(row["data"])


_ADDRESS = re.compile(r"^\s*(?:0x)?([0-9a-fA-F]+):")


def read_hex(text: str, linktype: int | None = ETH, strict: bool = False):
    """Yield packets of hex text: a blank line ends one, # starts a comment, an address may lead a line.

    Without a link type the bytes are XPKT records.
    """
    n, held = 0, bytearray()

    def done():
        if linktype is None:
            return list(read_xpkt(bytes(held)))
        return [EMPTY_TAGS | {"pkt_no": 0, "src_id": 0, "dltype": linktype, "data": bytes(held)}]

    for line in [*text.split("\n"), ""]:
        line = line.split("#")[0].rstrip()
        if not line.strip():
            for row in done() if held else []:
                n += 1
                yield row | {"pkt_no": n}
            held = bytearray()
            continue
        m = _ADDRESS.match(line)
        if m and strict and int(m[1], 16) != len(held):
            raise ValueError(f"address {m[1]} where {len(held):x} was expected")
        digits = re.match(r"[0-9a-fA-F\s]*", line[m.end() if m else 0 :])[0]
        held += bytes.fromhex("".join(digits.split()))


@lru_cache
def _shown(proto: str | None, n_fields: int) -> list:
    """A protocol's fields of fixed size, of so many registered ones."""
    return [f for f in FIELDS.values() if f.proto == proto and f.kind in ("bytes", "bits")]


def to_hex(row: dict) -> str:
    """A packet as annotated text that read_hex reads again."""
    data = bytes(row["data"])
    out = [f"# packet {row.get('pkt_no')}, {len(data)} bytes"]
    for u in dissect_bytes(data, row["dltype"])[1:]:
        out.append(f"# {u.proto} at {u.soff}, header {u.poff - u.soff}, payload {u.toff - u.poff}, errors {u.error}")
        for f in _shown(NAME.get(u.prid), len(FIELDS)):
            if f.base != "soff" and f.base not in u.xoffs:
                continue
            at = (u.soff if f.base == "soff" else u.xoffs[f.base]) + f.off
            if f.kind == "bytes":
                out.append(f"#   {f.name}: {data[at : at + f.size].hex()}")
            else:
                k = (f.bit + f.size + 7) // 8
                out.append(f"#   {f.name}: {int.from_bytes(data[at : at + k], 'big') >> (k * 8 - f.bit - f.size) & ((1 << f.size) - 1)}")
    out += [f"{at:06x}: {data[at : at + 16].hex(' ')}" for at in range(0, len(data), 16)]
    return "\n".join(out) + "\n"


COLUMNS = PACKET.names

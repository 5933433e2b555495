"""IP fragmentation and reassembly, TCP stream carving."""

from __future__ import annotations

import struct

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wirelake.functions.bytesx import be_uint, bits, cut
from wirelake.functions.dissect import fixed, ones_complement
from wirelake.functions.fields import field, number, unit
from wirelake.operators.edit import Packet, rows_of, table_of
from wirelake.operators.order import running
from wirelake.schema import IP, IP6, PACKET


def fragment_packet(data: bytes, dltype: int, mtu: int, ident: int, v4: bool = True, v6: bool = True, allow_df: bool = False) -> list[bytes] | None:
    """Fragments of a packet whose network part is longer than mtu; None if it isn't cut."""
    p = Packet(data, dltype)
    net = next((u for u in p.units[1:] if u.prid in (IP, IP6)), None)
    if net is None or net.toff - net.soff <= mtu:
        return None
    link, s = data[: net.soff], net.soff
    if net.prid == IP and v4:
        flags = struct.unpack_from(">H", data, s + 6)[0]
        if flags & 0x4000 and not allow_df:
            return None
        first, later = data[s : net.poff], data[s : s + 20] + _copied_options(data[s + 20 : net.poff])
        body, base, more = data[net.poff : net.toff], flags & 0x1FFF, flags & 0x2000
        out, at = [], 0
        while at < len(body):
            head = bytearray(later if at else first)
            n = mtu - len(head)
            n = n if at + n >= len(body) else n // 8 * 8
            if n <= 0:
                return None
            part = body[at : at + n]
            last = at + n >= len(body)
            head[0] = 0x40 | len(head) // 4
            head[2:4] = struct.pack(">H", len(head) + len(part))
            if flags & 0x3FFF == 0:
                head[4:6] = head[4:6] if any(head[4:6]) else struct.pack(">H", ident & 0xFFFF)
            head[6:8] = struct.pack(">H", base + at // 8 | (more if last else 0x2000))
            out.append(_with_checksum(link, head) + part)
            at += n
        return out
    if net.prid == IP6 and v6:
        own = net.xoffs.get("rtopt")
        unfragmentable = s + 40 if own is None else own + 8 + data[own + 1] * 8
        if own is None and "hopopt" in net.xoffs:
            unfragmentable = net.xoffs["hopopt"] + 8 + data[net.xoffs["hopopt"] + 1] * 8
        head, body = bytearray(data[s:unfragmentable]), data[unfragmentable : net.toff]
        place = 6 if unfragmentable == s + 40 else (own if own is not None else net.xoffs["hopopt"]) - s
        nxt, head[place] = head[place], 44
        n = (mtu - len(head) - 8) // 8 * 8
        if n <= 0:
            return None
        out = []
        for at in range(0, len(body), n):
            part = body[at : at + n]
            frag = struct.pack(">BBHI", nxt, 0, at | (at + n < len(body)), ident & 0xFFFFFFFF)
            head[4:6] = struct.pack(">H", len(head) - 40 + 8 + len(part))
            out.append(link + bytes(head) + frag + part)
        return out
    return None


def _copied_options(options: bytes) -> bytes:
    """The options that go into every fragment, padded."""
    out, at = b"", 0
    while at < len(options) and options[at]:
        n = 1 if options[at] == 1 else options[at + 1] if at + 1 < len(options) else 1
        if options[at] & 0x80:
            out += options[at : at + n]
        at += max(n, 1)
    return out + bytes(-len(out) % 4)


def _with_checksum(link: bytes, head: bytearray) -> bytes:
    head[10:12] = b"\0\0"
    head[10:12] = struct.pack(">H", ~ones_complement(bytes(head)) & 0xFFFF)
    return link + bytes(head)


def fragment(packets: DataFrame, mtu: int = 1500, first_id: int = 1, v4: bool = True, v6: bool = True, df: str = "drop") -> DataFrame:
    """Cut long IP packets; df says what becomes of those that may not be cut: drop, pass or fragment.

    Adds sub_no. Identifiers count the packets that are cut, in order; fragments carry no tags.
    """

    def pieces(data: bytes, dltype: int, ident: int):
        got = fragment_packet(data, dltype, mtu, ident, v4, v6, df == "fragment")
        if got is None and df == "drop":
            p = Packet(data, dltype)
            net = p.find("ip")
            if net is not None and v4 and net.toff - net.soff > mtu and data[net.soff + 6] & 0x40:
                return []
        return got

    size = F.length("data") - F.when(F.col("dltype") == 0x0201, 14).otherwise(0)
    rows = running(packets, F.when(size > mtu, 1).otherwise(0), "__id").withColumn("__id", F.col("__id") + first_id - 1)
    schema = T.StructType([*packets.schema.fields, T.StructField("sub_no", T.IntegerType())])

    def fit(batches):
        for batch in batches:
            out = []
            for row in rows_of(batch):
                got = pieces(row["data"], row["dltype"], row["__id"])
                if got is None:
                    out.append(row | {"sub_no": 0})
                else:
                    bare = {k: row[k] if k in ("pkt_no", "src_id", "dltype") or k not in PACKET.names else None for k in row}
                    out += [bare | {"data": d, "sub_no": k} for k, d in enumerate(got)]
            yield from table_of(out, schema).to_batches()

    return rows.mapInArrow(fit, schema)


def reassemble(packets: DataFrame, v4: bool = True, v6: bool = True, order: tuple[str, ...] = ("src_id", "pkt_no")) -> DataFrame:
    """Whole packets in place of their fragments, at the place of the fragment that completes them.

    Datagrams that stay incomplete are left out, other packets pass. Needs ``pdus``. Fragments meet by
    addresses and identifier; the first bytes to arrive win.
    """
    rows = fixed(packets, __ip=unit("ip"), __ip6=unit("ip6"))
    ip, ip6, d = F.col("__ip"), F.col("__ip6"), F.col("data")
    rows = fixed(rows, __mf=bits(d, ip["soff"] + 6, 2, 1), __at4=bits(d, ip["soff"] + 6, 3, 13), __at6=ip6["xoffs"]["fragh"])
    at6 = F.col("__at6")
    is4 = ip.isNotNull() & ((F.col("__mf") == 1) | (F.col("__at4") > 0)) if v4 else F.lit(False)
    is6 = at6.isNotNull() if v6 else F.lit(False)
    key4 = F.when(ip["soff"] + 20 <= ip["eoff"], F.concat(cut(d, ip["soff"] + 12, 8), cut(d, ip["soff"] + 4, 2)))
    key6 = F.when(ip6["soff"] + 40 <= ip6["eoff"], F.concat(cut(d, ip6["soff"] + 8, 32), cut(d, at6 + 4, 4)))
    marked = fixed(rows, **{
        "__key": F.when(is4, key4).when(is6, key6),
        "__net": F.when(is4, ip["soff"]).when(is6, ip6["soff"]),
        "__poff": F.when(is4, ip["poff"]).when(is6, at6 + 8),
        "__toff": F.when(is4, ip["toff"]).when(is6, ip6["toff"]),
        "__off": F.when(is4, F.col("__at4") * 8).when(is6, bits(d, at6 + 2, 0, 13) * 8),
        "__more": F.when(is4, F.col("__mf")).when(is6, bits(d, at6 + 3, 7, 1)),
        "__fragh": F.when(is6, at6), "__next": F.when(is6, be_uint(d, at6, 1)),
    })
    names = [c for c in packets.columns if c != "pdus"]
    inner = ["__key", "__net", "__poff", "__toff", "__off", "__more", "__fragh", "__next"]
    out_schema = packets.select(*names).schema
    kinds = to_arrow_schema(out_schema)

    def fit(batches):
        key, held, end, start = None, [], None, None
        for batch in batches:
            alone = batch.column("__key").is_null()
            if alone.true_count:
                yield from pa.Table.from_batches([batch.filter(alone).select(names)]).cast(kinds).to_batches()
                batch = batch.filter(pc.invert(alone))
            out = []
            for row in rows_of(batch):
                if row["__key"] != key:
                    key, held, end, start = row["__key"], [], None, None
                body = row["data"][row["__poff"] : row["__toff"]]
                held.append((row["__off"], body))
                if not row["__off"]:
                    start = start or row
                if not row["__more"]:
                    end = row["__off"] + len(body)
                if end is None or start is None:
                    continue
                whole = filled(held, end)
                if whole is None:
                    continue
                bare = {k: None if k in PACKET.names and k not in ("pkt_no", "src_id", "dltype") else row[k] for k in names}
                out.append(bare | {"data": rejoined(start, whole), "dltype": start["dltype"]})
                held, end, start = [], None, None
            yield from table_of(out, out_schema).to_batches()

    # packets that aren't fragments go along, dealt by what they are
    meet = F.coalesce("__key", F.unhex(F.hex(F.xxhash64("data", *order))))
    return marked.select(*names, *inner).repartition(meet).sortWithinPartitions("__key", *order).mapInArrow(fit, out_schema)


def filled(held: list[tuple[int, bytes]], end: int) -> bytearray | None:
    """The bytes up to end, where the first to arrive win; None while some are missing."""
    whole, gaps = bytearray(end), [(0, end)]
    for at, part in held:
        left = []
        for a, b in gaps:
            lo, hi = max(a, at), min(b, at + len(part))
            if lo >= hi:
                left.append((a, b))
                continue
            whole[lo:hi] = part[lo - at : hi - at]
            left += [(x, y) for x, y in ((a, lo), (hi, b)) if x < y]
        gaps = left
    return None if gaps else whole


def rejoined(start: dict, body: bytearray) -> bytes:
    """A whole packet from the headers of its first fragment and all of its bytes."""
    net, size = start["__net"], len(body)
    if start["__fragh"] is None:
        head = bytearray(start["data"][net : start["__poff"]])
        head[2:4] = struct.pack(">H", min(len(head) + size, 65535))
        head[6:8] = b"\0\0"
        return _with_checksum(start["data"][:net], head) + bytes(body)
    head = bytearray(start["data"][net : start["__fragh"]])
    place, kind, at = 6, head[6], 40
    while kind != 44 and at < len(head):
        place, kind, at = at, head[at], at + 8 + head[at + 1] * 8
    head[place] = start["__next"]
    head[4:6] = struct.pack(">H", min(len(head) - 40 + size, 65535))
    return start["data"][:net] + bytes(head) + bytes(body)


def carve(packets: DataFrame, gap: int = 0xDB) -> DataFrame:
    """The byte streams of each TCP connection: (conn, file_no, direction, bytes).

    A connection's first packet says who the client is. A new file starts whenever data changes its
    direction. Segments are put in sequence order, repeats dropped, overlaps trimmed, gaps filled.
    Needs ``pdus``.
    """
    tcp, ip = unit("tcp"), F.coalesce(field("ip.saddr"), field("ip6.saddr"))
    src, dst = F.concat(ip, field("tcp.sport")), F.concat(F.coalesce(field("ip.daddr"), field("ip6.daddr")), field("tcp.dport"))
    rows = packets.where(tcp.isNotNull() & ip.isNotNull()).select(
        "src_id", "pkt_no", src.alias("src"), F.concat(F.least(src, dst), F.greatest(src, dst)).alias("conn"), number("tcp.seqn").alias("seqn"),
        number("tcp.ack").alias("ack"), number("tcp.syn").alias("syn"), field("tcp.payload").alias("body"),
    )
    schema = T.StructType([T.StructField("conn", T.BinaryType()), T.StructField("file_no", T.IntegerType()), T.StructField("direction", T.StringType()), T.StructField("bytes", T.BinaryType())])

    def fit(batches):
        stream = None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if stream is None or stream.conn != r["conn"]:
                    out += stream.flush() if stream is not None else []
                    stream = _Stream(r["conn"], r["src"], gap)
                out += stream.take(r)
            yield from table_of(out, schema).to_batches()
        if stream is not None:
            yield from table_of(stream.flush(), schema).to_batches()

    return rows.repartition("conn").sortWithinPartitions("conn", "src_id", "pkt_no").drop("src_id", "pkt_no").mapInArrow(fit, schema)


class _Stream:
    """One connection's state while its packets go by."""

    def __init__(self, conn: bytes, client: bytes, gap: int):
        self.conn, self.client, self.gap = conn, client, gap
        self.base: dict[bytes, int] = {}
        self.run: list[tuple[int, bytes]] = []
        self.way: bytes | None = None
        self.files = 0

    def take(self, r: dict) -> list[dict]:
        out = []
        if r["syn"]:
            self.base[r["src"]] = r["seqn"] + 1 & 0xFFFFFFFF
        if r["ack"] and r["body"]:
            if self.way is not None and r["src"] != self.way:
                out = self.flush()
            self.way = r["src"]
            self.run.append((r["seqn"], r["body"]))
        return out

    def flush(self) -> list[dict]:
        """The file that ends here: segments in sequence order, repeats dropped, overlaps trimmed, gaps filled."""
        if not self.run:
            return []
        first = self.base.setdefault(self.way, self.run[0][0])
        segments = sorted((((s - first + (1 << 31)) & 0xFFFFFFFF) - (1 << 31), k, b) for k, (s, b) in enumerate(self.run))
        data, at = bytearray(), 0
        for off, _, body in segments:
            if off > at:
                data += bytes([self.gap]) * (off - at)
                at = off
            part = body[at - off :] if off < at else body
            data += part
            at += len(part)
        self.base[self.way], self.run = first + at & 0xFFFFFFFF, []
        self.files += 1
        return [{"conn": self.conn, "file_no": self.files - 1, "direction": "C2S" if self.way == self.client else "S2C", "bytes": bytes(data)}]

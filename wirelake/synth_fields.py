"""Packets of every protocol, one per event, from layouts written in wire order.

A layout is a list of items (name, bits, value); the value is a number or an expression of an event's
columns that Spark and other SQL engines both understand, or a list of (bits, value) for wide fields.
``group`` names the bytes of several items. The same values, not the packets' bytes, make the SQL that
the dissected fields are held against.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelake.functions.bytesx import be_bytes
from wirelake.functions.fields import field, number, present
from wirelake.functions.registry import FIELDS
from wirelake.schema import ETH, PACKET
from wirelake.synth import events

E, U = "event_id", "user_id"
CKSUM = f"{E} * 31 % 65521"


def group(name: str, *items):
    return (name, None, list(items))


def v6(low: str):
    return [(32, 0x20010DB8), (32, 0), (32, f"{U} * 7 % 65536"), (32, low)]


def mac(first: int, low: str):
    return [(16, first), (32, low)]


def eth(kind: int, *tags):
    return [("eth.dst", 48, mac(0x0211, U)), ("eth.src", 48, mac(0x0200, E)), *tags, ("eth.ethtype", 16, kind)]


def vlan(name: str, tpid: int, pri: str, cfi: str, vid: str):
    return group(name, (f"{name}.tpid", 16, tpid), (f"{name}.pri", 3, pri), (f"{name}.cfi", 1, cfi), (f"{name}.vid", 12, vid))


def ip(proto: int, size: int, *options, ihl: int = 5, flags: str = "0", fragment: str = "0"):
    return [
        ("ip.vers", 4, 4), ("ip.ihl", 4, ihl), ("ip.diffsrv", 6, f"{E} % 64"), ("ip.ecn", 2, f"{U} % 4"), ("ip.len", 16, ihl * 4 + size), ("ip.id", 16, f"{E} % 65536"),
        ("ip.rf", 1, f"{E} % 2"), ("ip.df", 1, f"({E} + 1) % 2"), ("ip.mf", 1, flags), ("ip.fragoff", 13, fragment), ("ip.ttl", 8, f"1 + {E} % 200"), ("ip.proto", 8, proto), ("ip.cksum", 16, CKSUM),
        ("ip.saddr", 32, f"167772160 + {U}"), ("ip.daddr", 32, f"3232235520 + {E} % 65536"), *([group("ip.opt", *options)] if options else []),
    ]


def ip6(nxt: int, size: int, *extensions, last: int | None = None):
    return [
        ("ip6.vers", 4, 6), ("ip6.class", 8, f"{E} % 256"), ("ip6.flowid", 20, f"{E} * 13 % 1048576"), ("ip6.len", 16, size), ("ip6.nxthdr", 8, nxt), ("ip6.hoplim", 8, f"1 + {U} % 200"),
        ("ip6.saddr", 128, v6(E)), ("ip6.daddr", 128, v6(f"{E} + 1")), *([group("ip6.exth", *extensions)] if extensions else []),
    ]


def icmp(kind: int, code: int, *rest):
    return [*eth(0x0800), *ip(1, 28), ("icmp.type", 8, kind), ("icmp.code", 8, code), ("icmp.cksum", 16, CKSUM), *rest]


def icmp6(kind: int, size: int, *rest):
    return [*eth(0x86DD), *ip6(58, 4 + size), ("icmp6.type", 8, kind), ("icmp6.code", 8, f"{E} % 3"), ("icmp6.cksum", 16, CKSUM), *rest]


def udp(dport, size: int):
    return [("udp.sport", 16, f"1024 + {U} % 60000"), ("udp.dport", 16, dport), ("udp.len", 16, 8 + size), ("udp.cksum", 16, f"1 + {E} % 65535")]


def tcp(words: int, *options):
    flags = [(f"tcp.{n}", 1, f"{E} / {1 << k} % 2") for k, n in enumerate(("cwr", "ece", "urg", "ack", "psh", "rst", "syn", "fin"))]
    return [
        ("tcp.sport", 16, f"1024 + {U} % 60000"), ("tcp.dport", 16, f"{E} % 65536"), ("tcp.seqn", 32, f"{E} * 40503 % 4294967296"), ("tcp.ackn", 32, f"{E} * 69069 % 4294967296"),
        ("tcp.doff", 4, words), ("tcp.resv", 4, f"{E} % 16"), *flags, ("tcp.win", 16, f"{U} * 11 % 65536"), ("tcp.cksum", 16, CKSUM), ("tcp.urgp", 16, f"{E} * 3 % 65536"), group("tcp.opt", *options),
    ]


def option(name: str, kind: int, size: int, *rest, more=()):
    return group(name, (f"{name}.kind", 8, kind), (f"{name}.len", 8, size), *rest, *more)


def nd(name: str, kind: int, words: int, *rest):
    return group(name, (f"{name}.type", 8, kind), (f"{name}.len", 8, words), *rest)


def label(name: str, bottom: int, k: int):
    return [(f"{name}.label", 20, f"({E} + {k}) * 5 % 1048576"), (f"{name}.tc", 3, f"({E} + {k}) % 8"), (f"{name}.bos", 1, bottom), (f"{name}.ttl", 8, f"({U} + {k}) % 256")]


TAIL = ("", 32, E)
NOP = ("", 8, 1)
#: Each layout, and the index of every unit in it.
LAYOUTS: dict[str, tuple[list, dict[str, int]]] = {
    "vlan": ([*eth(0x9999, vlan("eth.vlan0", 0x88A8, f"{E} % 8", f"{E} % 2", f"{U} % 4096"), vlan("eth.vlan1", 0x8100, f"({E} + 3) % 8", f"({E} + 1) % 2", f"{E} % 4096")), TAIL], {"eth": 1, "ip": 0}),
    "arp": ([*eth(0x0806), ("arp.hwfmt", 16, 1), ("arp.prfmt", 16, 0x0800), ("arp.hwlen", 8, 6), ("arp.prlen", 8, 4), ("arp.op", 16, f"1 + {E} % 2"), ("arp.sndhwaddr", 48, mac(0x0203, E)), ("arp.sndpraddr", 32, f"167772160 + {U}"), ("arp.trghwaddr", 48, mac(0x0204, U)), ("arp.trgpraddr", 32, f"167772160 + {E}")], {"eth": 1, "arp": 2}),
    "ip_options": ([*eth(0x0800), *ip(253, 4, ("", 8, 7), ("", 8, 11), ("", 8, 4), ("", 32, E), ("", 32, U), ("", 8, 0), ihl=8, flags=f"{U} % 2", fragment=f"{E} % 100"), TAIL], {"eth": 1, "ip": 2}),
    "ip6_extensions": ([*eth(0x86DD), *ip6(0, 20, ("", 8, 60), ("", 8, 0), ("", 16, 0x0104), ("", 32, 0), ("ip6.xnxthdr", 8, 59), ("", 8, 0), ("", 16, 0x0104), ("", 32, 0)), TAIL], {"eth": 1, "ip6": 2}),
    "icmp_echo": (icmp(8, 0, ("icmp.id", 16, f"{U} % 65536"), ("icmp.seq", 16, f"{E} % 65536"), *[TAIL] * 5), {"ip": 2, "icmp": 3}),
    "icmp_time": (icmp(13, 0, ("icmp.id", 16, f"{U} % 65536"), ("icmp.seq", 16, f"{E} % 65536"), ("icmp.ots", 32, f"{E} * 9"), ("icmp.rts", 32, f"{E} * 9 + 1"), ("icmp.tts", 32, f"{E} * 9 + 2"), *[TAIL] * 2), {"icmp": 3}),
    "icmp_mtu": (icmp(3, 4, ("icmp.mtu_resv", 16, f"{U} % 65536"), ("icmp.mtu", 16, f"576 + {E} % 900"), *[TAIL] * 5), {"icmp": 3}),
    "icmp_problem": (icmp(12, 0, ("icmp.ptr", 8, f"{E} % 256"), ("icmp.ptr_resv", 24, f"{U} % 65536"), *[TAIL] * 5), {"icmp": 3}),
    "icmp_redirect": (icmp(5, 1, ("icmp.gw", 32, f"167772160 + {E}"), *[TAIL] * 5), {"icmp": 3}),
    "icmp_exceeded": (icmp(11, 0, ("icmp.resv", 32, f"{E} * 17"), *[TAIL] * 5), {"icmp": 3}),
    "icmp6_echo": (icmp6(128, 8, group("icmp6.echo", ("icmp6.echo.id", 16, f"{U} % 65536"), ("icmp6.echo.seq", 16, f"{E} % 65536")), TAIL), {"ip6": 2, "icmp6": 3}),
    "icmp6_unreachable": (icmp6(1, 8, ("icmp6.eresv", 32, f"{E} * 17"), TAIL), {"icmp6": 3}),
    "icmp6_too_big": (icmp6(2, 8, ("icmp6.pptr", 32, f"1280 + {E} % 200"), TAIL), {"icmp6": 3}),
    "nd_solicit": (icmp6(133, 12, group("icmp6.rsol", ("icmp6.rsol.resv", 32, f"{E} * 3")), group("icmp6.rsol.opts", nd("icmp6.srclla", 1, 1, ("icmp6.srclla.addr", 48, mac(0x0205, E))))), {"icmp6": 3}),
    "nd_advertise": (icmp6(134, 68,
        group("icmp6.radv", ("icmp6.radv.hoplim", 8, f"{E} % 256"), ("icmp6.radv.mcfg", 1, f"{E} % 2"), ("icmp6.radv.ocfg", 1, f"{U} % 2"), ("icmp6.radv.resv", 6, f"{E} % 64"), ("icmp6.radv.tlife", 16, f"{U} % 65536"), ("icmp6.radv.treach", 32, f"{E} * 5"), ("icmp6.radv.tretry", 32, f"{E} * 6")),
        group("icmp6.radv.opts",
            nd("icmp6.omtu", 5, 1, ("icmp6.omtu.resv", 16, f"{U} % 65536"), ("icmp6.omtu.mtu", 32, f"1280 + {E} % 200")),
            nd("icmp6.pfxinfo", 3, 4, ("icmp6.pfxinfo.pfxlen", 8, f"{E} % 129"), ("icmp6.pfxinfo.onlink", 1, f"{E} % 2"), ("icmp6.pfxinfo.auto", 1, f"{U} % 2"), ("icmp6.pfxinfo.resv", 6, f"{E} % 64"), ("icmp6.pfxinfo.vlife", 32, f"{E} * 7"), ("icmp6.pfxinfo.plife", 32, f"{E} * 8"), ("icmp6.pfxinfo.resv2", 32, f"{U} * 9"), ("icmp6.pfxinfo.pfx", 128, v6(E))),
            nd("icmp6.radvivl", 7, 1, ("icmp6.radvivl.resv", 16, f"{E} % 65536"), ("icmp6.radvivl.ival", 32, f"{E} * 11")),
            nd("icmp6.agtinfo", 8, 1, ("icmp6.agtinfo.resv", 16, f"{U} % 65536"), ("icmp6.agtinfo.pref", 16, f"{E} % 65536"), ("icmp6.agtinfo.life", 16, f"({E} + 1) % 65536")))), {"icmp6": 3}),
    "nd_neighbour": (icmp6(136, 28, group("icmp6.neigh", ("icmp6.neigh.rtr", 1, f"{E} % 2"), ("icmp6.neigh.sol", 1, f"{U} % 2"), ("icmp6.neigh.ovd", 1, f"({E} + 1) % 2"), ("icmp6.neigh.resv", 29, f"{E} * 3 % 536870912"), ("icmp6.neigh.ip6a", 128, v6(E))), group("icmp6.neigh.opts", nd("icmp6.tgtlla", 2, 1, ("icmp6.tgtlla.addr", 48, mac(0x0206, U))))), {"icmp6": 3}),
    "nd_redirect": (icmp6(137, 52, group("icmp6.nrdr", ("", 32, 0), ("icmp6.nrdr.tgtaddr", 128, v6(E)), ("icmp6.nrdr.dstaddr", 128, v6(U))), group("icmp6.nrdr.opts", nd("icmp6.rdrhdr", 4, 2, ("icmp6.rdrhdr.resv", 48, mac(1, E)), group("icmp6.rdrhdr.opkt", ("", 32, E), ("", 32, U))))), {"icmp6": 3}),
    "udp": ([*eth(0x0800), *ip(17, 12), *udp(f"5000 + {E} % 1000", 4), TAIL], {"eth": 1, "ip": 2, "udp": 3, "tcp": 0}),
    "tcp_options": ([*eth(0x0800), *ip(6, 56), *tcp(13, option("tcp.mss", 2, 4, ("tcp.mss.mss", 16, f"536 + {E} % 900")), option("tcp.wscale", 3, 3, ("tcp.wscale.scale", 8, f"{E} % 15"), more=[NOP]), option("tcp.sackok", 4, 2), option("tcp.sack", 5, 10, group("tcp.sack.blocks", ("", 32, E), ("", 32, f"{E} + {U}"))), option("tcp.ts", 8, 10, ("tcp.ts.val", 32, f"{E} * 3"), ("tcp.ts.echo", 32, f"{E} * 2")), NOP, NOP), TAIL], {"ip": 2, "tcp": 3, "tcp.mss": 1, "tcp.sack": 1, "tcp.md5": 0}),
    "tcp_md5": ([*eth(0x0800), *ip(6, 44), *tcp(10, option("tcp.md5", 19, 18, ("tcp.md5.sig", 128, v6(E))), NOP, NOP), TAIL], {"tcp": 3, "tcp.md5": 1, "tcp.ts": 0}),
    "gre": ([*eth(0x0800), *ip(47, 20), ("gre.c_flag", 1, 1), ("gre.r_flag", 1, 0), ("gre.k_flag", 1, 1), ("gre.s_flag", 1, 1), ("", 9, 0), ("gre.vers", 3, f"{E} % 8"), ("gre.proto", 16, 0x1234), ("gre.cksum", 16, CKSUM), ("", 16, 0), ("gre.key", 32, f"{E} * 3"), ("gre.seq", 32, f"{E} * 4"), TAIL], {"ip": 2, "gre": 3, "nvgre": 0}),
    "nvgre": ([*eth(0x0800), *ip(47, 26), ("nvgre.c_flag", 1, 0), ("nvgre.r_flag", 1, 0), ("nvgre.k_flag", 1, 1), ("nvgre.s_flag", 1, 0), ("", 9, 0), ("nvgre.vers", 3, 0), ("nvgre.proto", 16, 0x6558), ("nvgre.vsid", 24, f"{E} % 16777216"), ("nvgre.flowid", 8, f"{U} % 256"), ("", 48, mac(2, E)), ("", 48, mac(2, U)), ("", 16, 0x9999), TAIL], {"ip": 2, "nvgre": 3, "gre": 0}),
    "vxlan": ([*eth(0x0800), *ip(17, 34), *udp(4789, 26), ("", 4, 0), ("vxlan.vni_flag", 1, 1), ("", 3, 0), ("", 24, 0), ("vxlan.vsid", 24, f"{E} % 16777216"), ("", 8, 0), ("", 48, mac(2, E)), ("", 48, mac(2, U)), ("", 16, 0x9999), TAIL], {"udp": 3, "vxlan": 4}),
    "mpls": ([*eth(0x8847), *label("mpls", 0, 0), *[group(f"mpls.mpls{k}", *label(f"mpls.mpls{k}", int(k == 3), k)) for k in (1, 2, 3)], ("", 32, 0)], {"eth": 1, "mpls": 2}),
}


def flat(items) -> list[tuple[str, int, object]]:
    """Items without groups; wide values in parts."""
    out = []
    for name, bits, value in items:
        if bits is None:
            out += flat(value)
        elif isinstance(value, list):
            out += [("", b, v) for b, v in value]
        else:
            out.append((name, bits, value))
    return out


def chunks(items) -> list[tuple[int, str]]:
    """(bytes, expression) of the shortest runs of items that fill whole bytes."""
    out, bits, parts = [], 0, []
    for _, n, value in flat(items):
        bits, parts = bits + n, [f"({p}) * {1 << n}" for p in parts] + [str(value)]
        if bits % 8 == 0:
            out.append((bits // 8, " + ".join(f"({p})" for p in parts)))
            bits, parts = 0, []
    if bits:
        raise ValueError("a layout must fill whole bytes")
    return out


def spark_sql(expression: str) -> Column:
    """Whole-number division is ``div`` in Spark."""
    return F.expr(expression.replace(" / ", " div ")).cast("long")


def packets(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    data = F.concat(*[be_bytes(spark_sql(e), n) for n, e in chunks(LAYOUTS[name][0])])
    made = {"pkt_no": F.col("event_id") + 1, "src_id": F.lit(0), "dltype": F.lit(ETH), "data": data}
    return events(spark, sf_dir).select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in PACKET])


def named(items) -> list[tuple[str, object]]:
    """(name, its items) of fields and groups."""
    out = []
    for item in items:
        name, bits, value = item
        if name:
            out.append((name, [item] if bits is not None else value))
        if bits is None:
            out += named(value)
    return out


def column(name: str) -> Column:
    f = FIELDS[name]
    return number(name).cast("long") if f.kind == "bits" else F.hex(field(name))


def dissected(pdus: DataFrame, name: str) -> DataFrame:
    """All fields of a layout: bits as numbers, bytes in hexadecimal digits, and the indices of its units."""
    items, units = LAYOUTS[name]
    fields = [column(n).alias(n.replace(".", "_")) for n, _ in named(items)]
    return pdus.select("pkt_no", *fields, *[present(u).cast("long").alias(f"at_{u.replace('.', '_')}") for u in units])


def sql(name: str) -> str:
    items, units = LAYOUTS[name]
    out = ["pkt_no"]
    for n, own in named(items):
        if FIELDS[n].kind == "bits":
            value = f"({own[0][2]})::BIGINT"
        else:
            value = " || ".join(f"upper(printf('%0{2 * b}x', ({e})::BIGINT))" for b, e in chunks(own))
        out.append(f"{value} AS {n.replace('.', '_')}")
    out += [f"{k}::BIGINT AS at_{u.replace('.', '_')}" for u, k in units.items()]
    return f"SELECT {', '.join(out)} FROM p".replace(" / ", " // ")

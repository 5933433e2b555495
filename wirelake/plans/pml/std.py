"""The standard library of the pattern language, built in.

``CONSTANTS`` are numbers, ``CALLS`` run inside the interpreter (machine, argument expressions) and
``COLUMNS`` are the same tests and values as Spark columns, for predicates that need no interpreter. A
program's own definition of a name comes first. ``NAME_pn`` takes the number of a packet before its
other arguments, ``NAME`` works on packet 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from wirelake.functions import bytesx as B
from wirelake.functions.fields import field, implicit, unit
from wirelake.schema import PRID

#: Fixed values of the language.
CONSTANTS = {
    "ETYPE_C_VLAN": 0x8100, "ETYPE_S_VLAN": 0x88A8, "VXLAN_PORT": 4789,
    "MAC_TYPE_ANY": 0, "MAC_TYPE_UNICAST": 1, "MAC_TYPE_LOC_UNICAST": 2, "MAC_TYPE_MULTICAST": 3,
}
ADDRESSES = {4: ("ip", "saddr", "daddr"), 16: ("ip6", "saddr", "daddr"), 6: ("eth", "src", "dst")}
VLANS = (CONSTANTS["ETYPE_C_VLAN"], CONSTANTS["ETYPE_S_VLAN"])
#: Where a label's parts lie in its 32 bits: shift and mask.
LABEL = {"label": (12, 0xFFFFF), "tc": (9, 7), "bos": (8, 1), "ttl": (0, 0xFF)}
TUNNELS = {"gre": ("eth", "ip", "gre"), "nvgre": ("eth", "ip", "nvgre"), "vxlan": ("eth", "ip", "udp", "vxlan")}

CALLS: dict[str, Callable] = {}


def both(f: Callable) -> Callable:
    """Register f(machine, packet number, *arguments) as NAME_pn and, for packet 0, as NAME."""
    CALLS[f"{f.__name__}_pn"] = lambda m, args: f(m, m.num(m.eval(args[0])), *args[1:])
    CALLS[f.__name__] = lambda m, args: f(m, 0, *args)
    return f


def one(f: Callable) -> Callable:
    CALLS[f.__name__] = lambda m, args: f(m, *args)
    return f


def _unit(m, pn: int, proto: str):
    row = m.slots[pn]
    return row["__p"].find(proto) if row else None


@both
def pkt_headroom(m, pn):
    u = m.packet(pn).units[0]
    return u.poff - u.soff


@both
def pkt_tailroom(m, pn):
    u = m.packet(pn).units[0]
    return u.eoff - u.toff


@one
def flowid(m):
    return m.tag_value(0, "flow_id")


@both
def fix(m, pn):
    m.packet(pn).finish()
    return 0


@both
def pdu_pop(m, pn):
    m.packet(pn).pop()
    return 0


@one
def pkt_splice(m, where, what):
    """Put other bytes, of any length, in the place of some bytes of a packet."""
    to, new = m.ref(where), m.text_of(what)
    if to.slot < 0:
        return 0xFFFFFFFF
    p, change = to.home, len(new) - to.size
    if change < 0:
        p.cut_bytes(to.at, -change)
    elif change > 0:
        p.insert_bytes(to.at, change)
    p.data[to.at : to.at + len(new)] = new
    return 0


SPACE = 1792


def _made(m, pn: int, protos: tuple[str, ...], size: int) -> int:
    p = m.new_packet(pn, size)
    for k, proto in enumerate(protos):
        p.insert(PRID[proto], k)
    return 0


@both
def mk_tcp(m, pn):
    _made(m, pn, ("eth", "ip", "tcp"), SPACE)
    m.packet(pn).fix_csums()
    return 0


@both
def mk_udp(m, pn):
    _made(m, pn, ("eth", "ip", "udp"), SPACE)
    p = m.packet(pn)
    p.fix_csums(p.find("ip"))
    p.parse()
    return 0


@both
def mk_arp(m, pn):
    return _made(m, pn, ("eth", "arp"), 0)


@both
def host(m, pn, address):
    want = m.text_of(address)
    proto, *ends = ADDRESSES.get(len(want), ("", ""))
    return int(bool(proto) and _unit(m, pn, proto) is not None and any(m.packet(pn).get(f"{proto}.{e}") == want for e in ends))


def _is_vlan(kind: int) -> int:
    return int(kind in VLANS)


@one
def etype_is_vlan(m, kind):
    return _is_vlan(m.num(m.eval(kind)))


@both
def vlan_present(m, pn):
    u = _unit(m, pn, "eth")
    return _is_vlan(int.from_bytes(m.packet(pn).data[u.soff + 12 : u.soff + 14], "big")) if u is not None else 0


@both
def vlan_push(m, pn, vid):
    if _unit(m, pn, "eth") is not None:
        m.packet(pn).vlan_push(m.num(m.eval(vid)) & 0xFFFF)
    return 0


@both
def vlan_pop(m, pn):
    if vlan_present(m, pn):
        m.packet(pn).vlan_pop()
    return 0


def _wrapper(protos: tuple[str, ...]) -> Callable:
    def call(m, args):
        for proto in reversed(protos):
            m.packet(0).insert(PRID[proto])
        return 0

    return call


def _unwrapper(protos: tuple[str, ...]) -> Callable:
    def call(m, args):
        p = m.packet(0)
        port = "udp" not in protos or (p.find("udp") is not None and int.from_bytes(p.get("udp.dport"), "big") == CONSTANTS["VXLAN_PORT"])
        if tuple(u.proto for u in p.units[1 : len(protos) + 1]) == protos and port:
            p.pop(len(protos))
        return 0

    return call


for _name in ("eth", "ip", "ip6", "icmp", "icmp6", "tcp", "udp", "gre", "nvgre", "vxlan"):
    CALLS[f"{_name}_wrap"] = _wrapper((_name,))
for _name, _protos in TUNNELS.items():
    CALLS[f"{_name}_encap"] = _wrapper(_protos)
    CALLS[f"{_name}_decap"] = _unwrapper(_protos)


@both
def mpls_nlabels(m, pn):
    u = _unit(m, pn, "mpls")
    if u is None:
        raise KeyError("mpls")
    return (u.poff - u.soff) // 4


def _label(m, pn: int, at) -> tuple:
    """The packet, where a label's four bytes start, and their value."""
    p, u, k = m.packet(pn), _unit(m, pn, "mpls"), m.num(m.eval(at)) * 4
    if u is None or u.soff + k + 4 > u.poff:
        raise KeyError("mpls")
    return p, u.soff + k, int.from_bytes(p.data[u.soff + k : u.soff + k + 4], "big")


def _label_part(part: str) -> None:
    shift, mask = LABEL[part]

    def get(m, pn, at):
        return _label(m, pn, at)[2] >> shift & mask

    def put(m, pn, at, value):
        p, start, old = _label(m, pn, at)
        p.data[start : start + 4] = (old & ~(mask << shift) | (m.num(m.eval(value)) & mask) << shift).to_bytes(4, "big")
        return 0

    get.__name__, put.__name__ = f"mpls_get_{part}", f"mpls_set_{part}"
    both(get)
    both(put)


for _name in LABEL:
    _label_part(_name)


@both
def mpls_push(m, pn, label, tc, ttl):
    """A label in front of the others, or around the whole packet where there is none."""
    p, (a, b, c) = m.packet(pn), (m.num(m.eval(x)) for x in (label, tc, ttl))
    word = (a & 0xFFFFF) << 12 | (b & 7) << 9 | c & 0xFF
    u = p.find("mpls")
    if u is None:
        p.insert(PRID["mpls"])
        u, word = p.find("mpls"), word | 0x100
    else:
        p.insert_bytes(u.soff, 4)
        u.soff -= 4
    p.data[u.soff : u.soff + 4] = word.to_bytes(4, "big")
    return 0


@both
def mpls_pop(m, pn):
    """The first label of an outermost stack, taken off; 0 where there is none."""
    p, u = m.packet(pn), _unit(m, pn, "mpls")
    if u is None or p.units.index(u) != 1:
        return 0
    word = int.from_bytes(p.data[u.soff : u.soff + 4], "big")
    p.cut_bytes(u.soff, 4)
    if u.poff <= u.soff:
        p.delete(1)
    return word


# A stream of bytes keyed by a seed (the published RC4 generator); its state is the globals rand_m, rand_i and rand_j.
@one
def rand_init(m, seed):
    key, s, j = m.text_of(seed), list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 0xFF
        s[i], s[j] = s[j], s[i]
    m.vars.update(rand_m=bytearray(s), rand_i=0, rand_j=0)
    return 0


def _byte(m) -> int:
    s = m.vars.setdefault("rand_m", bytearray(256))
    i = (m.vars.get("rand_i", 0) + 1) & 0xFF
    j = (m.vars.get("rand_j", 0) + s[i]) & 0xFF
    s[i], s[j] = s[j], s[i]
    m.vars.update(rand_i=i, rand_j=j)
    return s[(s[i] + s[j]) & 0xFF]


def _bytes(m, n: int) -> bytes:
    return bytes(_byte(m) for _ in range(n))


for _name, _n in (("rand_byte", 1), ("rand_short", 2), ("rand_int", 4)):
    CALLS[_name] = lambda m, args, n=_n: int.from_bytes(_bytes(m, n), "big")


@one
def rand_mac(m, to, kind):
    """Six random bytes into a string; the kind sets or clears the bits for groups and local addresses."""
    first, *rest = _bytes(m, 6)
    kinds = {"MAC_TYPE_UNICAST": first & 0xFC, "MAC_TYPE_LOC_UNICAST": first & 0xFE | 2, "MAC_TYPE_MULTICAST": first | 1}
    want = m.num(m.eval(kind))
    first = next((v for k, v in kinds.items() if CONSTANTS[k] == want), first)
    m.ref(to).put(bytes([first, *rest]))
    return 0


def _host_column(low, args) -> Column:
    want, tests = low.value(args[0]), []
    for size, (proto, *ends) in ADDRESSES.items():
        same = F.coalesce((field(f"{proto}.{ends[0]}") == want) | (field(f"{proto}.{ends[1]}") == want), F.lit(False))
        tests.append((F.length(want) == size) & same)
    return (tests[0] | tests[1] | tests[2]).cast("long")


def _tagged(kind: Column) -> Column:
    return F.coalesce(kind.isin(*VLANS), F.lit(False)).cast("long")


def _label_column(part: str) -> Callable:
    shift, mask = LABEL[part]
    return lambda low, args: F.shiftright(B.be_uint(field("mpls.header"), low.number(args[0]).cast("int") * 4, 4), shift).bitwiseAND(mask)


COLUMNS: dict[str, Callable] = {
    "host": _host_column,
    "flowid": lambda low, args: F.coalesce(B.u32(F.col("flow_id")), F.lit(B.U32).cast("long")),
    "pkt_headroom": lambda low, args: F.lit(0).cast("long"),
    "pkt_tailroom": lambda low, args: F.lit(0).cast("long"),
    "etype_is_vlan": lambda low, args: _tagged(low.number(args[0])),
    "vlan_present": lambda low, args: _tagged(B.be_uint(F.col("data"), unit("eth")["soff"] + 12, 2)),
    "mpls_nlabels": lambda low, args: F.floor(implicit("mpls", "hlen") / 4).cast("long"),
    **{f"mpls_get_{k}": _label_column(k) for k in LABEL},
}

"""Named packet fields as columns over ``data`` and ``pdus``.

``field("tcp.dport")`` is the value (bytes for byte fields, a number for bit fields), ``number`` its
integer view, ``present`` the index of its unit (1 for fields of an option, 0 when absent), and the
implicit members (``ip.plen``, ``tcp.payload`` ...) work for each protocol. Absent values are null;
``index`` of an absent unit is 0, and lengths of one are 4294967295.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wirelake.functions.bytesx import U32, bits, first_uint
from wirelake.functions.registry import CONSTANTS, FIELDS, IMPLICIT
from wirelake.schema import LAYER, PRID

LAYERS = ("link", "tunnel", "net", "xport")


def unit(proto: str, nth: int = 0) -> Column:
    """The nth data unit of a protocol, of a layer class (its first), or of any protocol (``pdu``)."""
    pdus = F.col("pdus")
    if proto == "pdu":
        return F.get(F.filter(pdus, lambda p: p["idx"] > 0), F.lit(nth))
    if proto in LAYERS:
        names = [k for k, v in LAYER.items() if v == proto]
        return F.get(F.filter(pdus, lambda p: p["proto"].isin(*names)), F.lit(nth))
    return F.get(F.filter(pdus, lambda p: p["proto"] == proto), F.lit(nth))


def _split(name: str) -> tuple[str, str]:
    proto, _, rest = name.partition(".")
    return proto, rest


def field(name: str, nth: int = 0) -> Column:
    if name in CONSTANTS:
        return F.lit(CONSTANTS[name][0])
    proto, rest = _split(name)
    u = unit(proto, nth)
    if rest in IMPLICIT or not rest or name not in FIELDS:
        return implicit(proto, rest or "pdu", nth)
    f = FIELDS[name]
    start = (u["soff"] if f.base == "soff" else u["xoffs"][f.base]) + f.off
    if f.kind == "bits":
        return bits(F.col("data"), start, f.bit, f.size)
    size = F.lit(f.size)
    if f.kind == "var":
        end = u["poff"] if f.end == "poff" else u["xoffs"][f.end]
        size = end - start
    return F.when((start + size <= u["eoff"]) & (size >= 0), F.substring(F.col("data"), start + 1, size))


def implicit(proto: str, member: str, nth: int = 0) -> Column:
    u = unit(proto, nth)
    data = F.col("data")

    def part(a: Column, b: Column) -> Column:
        return F.when(u.isNotNull(), F.substring(data, a + 1, b - a))

    def size(a: Column, b: Column) -> Column:
        return F.coalesce((b - a).cast("long"), F.lit(U32).cast("long"))

    return {
        "exists": lambda: F.coalesce(u["idx"], F.lit(0)).cast("long"),
        "index": lambda: F.coalesce(u["idx"], F.lit(0)).cast("long"),
        "hlen": lambda: size(u["soff"], u["poff"]),
        "plen": lambda: size(u["poff"], u["toff"]),
        "tlen": lambda: size(u["toff"], u["eoff"]),
        "totlen": lambda: size(u["soff"], u["eoff"]),
        "error": lambda: F.coalesce(u["error"].cast("long"), F.lit(U32).cast("long")),
        "prid": lambda: F.coalesce(u["prid"].cast("long"), F.lit(U32).cast("long")),
        "header": lambda: part(u["soff"], u["poff"]),
        "payload": lambda: part(u["poff"], u["toff"]),
        "trailer": lambda: part(u["toff"], u["eoff"]),
        "pdu": lambda: part(u["soff"], u["eoff"]),
    }[member]()


def number(name: str, nth: int = 0) -> Column:
    """The field as an unsigned integer (its first four bytes)."""
    f = FIELDS.get(name)
    value = field(name, nth)
    if (f is not None and f.kind == "bits") or _split(name)[1] in IMPLICIT[:8]:
        return value.cast("long")
    return first_uint(value)


def present(name: str, nth: int = 0) -> Column:
    name = name.removesuffix(".exists")
    proto, rest = _split(name)
    f = FIELDS.get(name)
    if rest and f is not None and f.optional:
        return F.coalesce(unit(proto, nth)["xoffs"][f.base].isNotNull().cast("long"), F.lit(0).cast("long"))
    return implicit(proto, "exists", nth)


def prid(proto: str) -> Column:
    return F.lit(PRID[proto]).cast("long")

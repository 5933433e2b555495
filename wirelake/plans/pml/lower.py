"""Expressions to columns: stateless tests become plain predicates that Spark plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wirelake.functions import bytesx as B
from wirelake.functions.fields import LAYERS, field, number, present
from wirelake.functions.registry import CONSTANTS, FIELDS, IMPLICIT
from wirelake.plans.pml import std
from wirelake.plans.pml.parse import PmlError, parse, parse_expression
from wirelake.schema import PRID

META = {"meta_get_ts_sec": "ts_sec", "meta_get_ts_nsec": "ts_nsec", "meta_get_presnap": "wirelen", "meta_get_inport": "in_iface", "meta_get_outport": "out_iface", "meta_get_flowid": "flow_id", "meta_get_class": "class", "meta_get_seq": "seq"}


class Lowering:
    """is_bytes tells values apart: byte strings stay binary columns, integers are unsigned longs."""

    def __init__(self, program: dict | None = None):
        self.inlines = (program or {}).get("inlines", {})
        self.names: dict = {}
        for name, e in (program or {}).get("consts", []):
            self.names[name] = e

    def is_bytes(self, e) -> bool:
        if e[0] == "bytes":
            return True
        if e[0] == "name":
            if e[1] in self.names:
                return self.is_bytes(self.names[e[1]])
            f = FIELDS.get(e[1])
            return e[4] is not None or e[1] in CONSTANTS or (f is not None and f.kind in ("bytes", "var")) or e[1].split(".")[-1] in ("header", "payload", "trailer", "pdu")
        return False

    def value(self, e) -> Column:
        """The byte string of a name or literal."""
        if e[0] == "bytes":
            return F.lit(e[1])
        _, name, slot, nth, part = e
        if name in self.names:
            return self.value(self.names[name])
        if slot != ("int", 0) or nth[0] != "int":
            raise PmlError("other packets and computed instances are left to the interpreter")
        proto = name.split(".")[0]
        base = field(name if "." in name else f"{name}.pdu", nth[1]) if proto in PRID or proto in LAYERS or proto == "pdu" or name in FIELDS else None
        if base is None:
            raise PmlError(f"unknown name {name}")
        if part is None:
            return base
        off, size = self.number(part[0]).cast("int"), self.number(part[1]).cast("int") if part[1] is not None else None
        return F.substring(base, off + 1, size if size is not None else F.length(base))

    def number(self, e) -> Column:
        kind = e[0]
        if kind == "int":
            return F.lit(e[1]).cast("long")
        if kind == "bytes":
            return F.lit(int.from_bytes(e[1][:4], "big")).cast("long")
        if kind == "prid":
            return F.lit(PRID[e[1]]).cast("long")
        if kind in ("and", "or", "not", "compare", "match"):
            return self.test(e).cast("long")
        if kind == "name" and e[1] in std.CONSTANTS and e[1] not in self.names:
            return F.lit(std.CONSTANTS[e[1]]).cast("long")
        if kind == "unary":
            x = self.number(e[2])
            return B.u32(~x if e[1] == "~" else -x) if e[1] == "-" else F.lit(B.U32).cast("long") - B.u32(x)
        if kind == "binary":
            op, a, b = e[1], self.number(e[2]), self.number(e[3])
            low = b.bitwiseAND(31).cast("int")
            return {
                "+": lambda: B.u32(a + b), "-": lambda: B.u32(a - b),
                "*": lambda: B.u32(B.u32(F.shiftright(a, 16) * b) .bitwiseAND(0xFFFF) * 65536 + a.bitwiseAND(0xFFFF) * b),
                "/": lambda: F.try_divide(a - F.try_mod(a, b), b).cast("long"), "%": lambda: F.try_mod(a, b),
                "&": lambda: a.bitwiseAND(b), "|": lambda: a.bitwiseOR(b), "^": lambda: a.bitwiseXOR(b),
                "<<": lambda: B.u32(F.call_function("shiftleft", a, low)), ">>": lambda: F.call_function("shiftright", a, low),
            }[op]()
        if kind == "call":
            return self.call(e)
        if kind == "name":
            if e[1] in self.names:
                return self.number(self.names[e[1]])
            if self.is_bytes(e):
                return B.first_uint(self.value(e))
            member = e[1].split(".")[-1]
            if e[1] in FIELDS and FIELDS[e[1]].kind == "bits":
                return number(e[1], e[3][1])
            if member in IMPLICIT and member != "exists":
                return number(e[1], e[3][1])
            base = e[1].removesuffix(".exists")
            if base not in PRID and base not in LAYERS and base != "pdu" and not any(f == base or f.startswith(f"{base}.") for f in FIELDS):
                raise PmlError(f"unknown name {e[1]}")
            return present(e[1], e[3][1])
        raise PmlError(f"{kind} has no integer value")

    def call(self, e) -> Column:
        _, name, args = e
        if name in self.inlines:
            params, body = self.inlines[name]
            inner = Lowering({"inlines": self.inlines})
            inner.names = self.names | dict(zip([n for n, _ in params], args, strict=True))
            return inner.number(body)
        if name in std.COLUMNS:
            return std.COLUMNS[name](self, args)
        if name in META:
            return F.coalesce(B.u32(F.col(META[name])), F.lit(B.U32).cast("long"))
        plain = {
            "pop": lambda a: B.pop_count(a), "log2": lambda a: B.log2(a),
            "min": lambda a, b: B.u32(F.least(B.s32(a), B.s32(b))), "max": lambda a, b: B.u32(F.greatest(B.s32(a), B.s32(b))),
        }
        if name in plain:
            return plain[name](*map(self.number, args))
        if name == "str_len":
            return F.length(self.value(args[0])).cast("long")
        if name == "str_isnull":
            return (F.coalesce(F.length(self.value(args[0])), F.lit(0)) == 0).cast("long")
        if name == "pkt_nlists":
            return F.lit(256).cast("long")
        raise PmlError(f"{name} is left to the interpreter")

    def test(self, e) -> Column:
        kind = e[0]
        if kind == "or":
            return F.when(self.test(e[1]), True).otherwise(self.test(e[2]))
        if kind == "and":
            return F.when(self.test(e[1]), self.test(e[2])).otherwise(False)
        if kind == "not":
            return ~self.test(e[1])
        if kind == "compare":
            _, op, l, r = e
            if op in ("==", "!=") and self.is_bytes(l) and self.is_bytes(r):
                same = self.value(l) == self.value(r)
                return same if op == "==" else ~same
            a, b = self.number(l), self.number(r)
            if op in ("==", "!="):
                return a == b if op == "==" else a != b
            a, b = B.s32(a), B.s32(b)
            return {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]
        if kind == "match":
            _, op, l, r = e
            v = self.value(l)
            if r[0] == "name" and r[1] in CONSTANTS and CONSTANTS[r[1]][1]:
                r = ("mask", *CONSTANTS[r[1]])
            same = B.regex_match(v, r[1]) if r[0] == "regex" else B.mask_eq(v, r[1], r[2]) if r[0] == "mask" else v == self.value(r)
            return same if op == "=~" else ~same
        return self.number(e) != 0


def predicate(text: str, library: str = "") -> Column:
    """A test as a boolean column over packets with ``pdus``; null where it reads a missing field."""
    return Lowering(parse(library)).test(parse_expression(text))

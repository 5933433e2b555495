"""Programs with state: packets in order through rules, one stream for each key."""

from __future__ import annotations

import copy
import ipaddress
import operator
import re
from collections import defaultdict, deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelake.functions.registry import CONSTANTS, FIELDS
from wirelake.operators.edit import Packet, rows_of, table_of
from wirelake.plans.pml import std
from wirelake.plans.pml.parse import PmlError, parse
from wirelake.plans.pml.state import independent
from wirelake.schema import LAYER, PACKET, PRID, RAW, TAG
from wirelake.sources.formats import put_tag, tag, tags

M = 0xFFFFFFFF
TAGS = {"ts_sec": "ts_sec", "ts_nsec": "ts_nsec", "presnap": "wirelen", "inport": "in_iface", "outport": "out_iface", "flowid": "flow_id", "class": "class", "seq": "seq"}
TAG_COLUMN = {TAG["timestamp"]: "ts_sec", TAG["snapinfo"]: "wirelen", TAG["iniface"]: "in_iface", TAG["outiface"]: "out_iface", TAG["flow"]: "flow_id", TAG["class"]: "class", TAG["seq"]: "seq"}
EMPTY_TAG = {1: tag(1, 0, bytes(8)), 2: tag(2, 0, bytes(4)), 3: tag(3), 4: tag(4), 5: tag(5, 0, bytes(8)), 6: tag(6, 0, bytes(8)), 7: tag(7, 0, bytes(8)), 8: tag(8, PRID["pkt"], bytes(8))}
APPINFO = 128
BUDGET = 10_000_000
TICK = 0.001
#: Rows of a table that goes back to Spark.
ROWS = 10_000


class _Jump(Exception):
    def __init__(self, kind: str, value=None):
        self.kind, self.value = kind, value


class Ref:
    """Bytes inside a packet (slot is its number) or a buffer (slot is -1); a null one has no home."""

    __slots__ = ("home", "at", "size", "slot")

    def __init__(self, home: Packet | bytearray | None = None, at: int = 0, size: int = 0, slot: int = -1):
        self.home, self.at, self.size, self.slot = home, at, size, slot

    @property
    def store(self) -> bytearray:
        return self.home.data if isinstance(self.home, Packet) else self.home if self.home is not None else bytearray()

    def value(self) -> bytes:
        return bytes(self.store[self.at : self.at + self.size])

    def part(self, off: int, size: int | None) -> Ref:
        if off > self.size or (size is not None and off + size > self.size):
            raise IndexError(f"bytes {off} to {off + (size or 0)} of {self.size}")
        return Ref(self.home, self.at + off, self.size - off if size is None else size, self.slot)

    def put(self, value: int | bytes) -> None:
        """Numbers fill the bytes from the right, byte strings from the left."""
        raw = value.to_bytes(max(self.size, 4), "big")[-self.size :] if isinstance(value, int) and self.size else value[: self.size] if isinstance(value, bytes) else b""
        self.store[self.at : self.at + len(raw)] = raw


class Machine:
    """One stream's state: variables, packet slots and lists.

    A variable is a number, a buffer of its own (bytearray) or a reference (Ref). ``budget`` is how many
    expressions one packet, or one run of another entry point, may evaluate.
    """

    def __init__(self, program: dict, on_error: str = "abort", budget: int = BUDGET):
        self.p, self.on_error, self.budget, self.left = program, on_error, budget, budget
        self.consts: dict = {}
        self.vars: dict = {}
        self.slots: dict[int, dict | None] = defaultdict(lambda: None)
        self.lists: dict[int, deque] = defaultdict(deque)
        self.out: list[dict] = []
        self.text: list[str] = []
        self.line = ""
        self.stack: list[dict] = []
        self.next_tick: float | None = None
        for name, e in program["consts"]:
            self.consts[name] = self.eval(e)
        for d in program["globals"]:
            self.declare(d)

    @staticmethod
    def num(v) -> int:
        return v if isinstance(v, int) else int.from_bytes(v[:4], "big")

    @staticmethod
    def signed(v: int) -> int:
        return v - (1 << 32) if v >> 31 else v

    def declare(self, d) -> None:
        _, scope, kind, name, size, value = d
        if scope == "global" and value is None and size is None and name in self.vars:
            return
        v = self.eval(value) if value is not None else 0
        if kind == "str":
            raw = v if isinstance(v, bytes) else b""
            n = self.num(self.eval(size)) if size is not None else len(raw)
            v = bytearray(raw[:n] + bytes(max(0, n - len(raw)))) if size is not None or value is not None else Ref()
        (self.vars if scope == "global" or not self.stack else self.stack[-1])[name] = v

    def scope(self, name: str) -> dict | None:
        """The variables that hold a name."""
        return next((s for s in ([self.stack[-1]] if self.stack else []) + [self.vars, self.consts] if name in s), None)

    def ref(self, e) -> Ref:
        """What an expression names as bytes that can be written; a buffer of its own for a plain value."""
        if e[0] == "name":
            _, name, slot, _, part = e
            scope = self.scope(name)
            if scope is None and name not in CONSTANTS:
                p, at, size = self.span(e)
                return Ref(p, at, size, self.num(self.eval(slot)))
            v = scope[name] if scope is not None else CONSTANTS[name][0]
            whole = v if isinstance(v, Ref) else Ref(v if isinstance(v, bytearray) else bytearray(v.to_bytes(4, "big") if isinstance(v, int) else v), 0, len(v) if not isinstance(v, int) else 4)
            return whole if part is None else whole.part(self.num(self.eval(part[0])), self.num(self.eval(part[1])) if part[1] is not None else None)
        if e[0] == "call" and e[1] == "str_mkref":
            in_packet, slot, at, size = (self.num(self.eval(a)) for a in e[2])
            if not in_packet:
                return Ref()
            p = self.packet(slot)
            if at + size > len(p.data):
                raise IndexError(f"bytes {at} to {at + size}")
            return Ref(p, at, size, slot)
        v = self.eval(e)
        raw = bytearray(v if isinstance(v, bytes) else v.to_bytes(4, "big"))
        return Ref(raw, 0, len(raw))

    def text_of(self, e) -> bytes:
        return self.ref(e).value()

    def new_packet(self, slot: int, size: int) -> Packet:
        p = Packet(bytes(size), RAW)
        self.slots[slot] = {c: None for c in PACKET.names} | {"src_id": 0, "dltype": RAW, "__p": p}
        return p

    def tag_value(self, slot: int, column: str) -> int:
        row = self.slots[slot]
        got = row.get(column) if row else None
        return M if got is None else int(got) & M

    def tag_bytes(self, slot: int, kind: int) -> tuple[bytes | None, int | None]:
        """A packet's first tag of a type, and its place among those that repeat."""
        row = self.slots[slot]
        if row is None:
            raise KeyError(f"no packet {slot}")
        got = next(iter(tags(row, kind)), None)
        at = 0 if kind == TAG["parseinfo"] else next((k for k, x in enumerate(row.get("appinfo") or []) if x[0] == kind), None)
        return got, at

    def packet(self, slot: int) -> Packet:
        row = self.slots[slot]
        if row is None:
            raise KeyError(f"no packet {slot}")
        return row["__p"]

    def unit(self, p: Packet, proto: str, nth: int):
        if proto in ("link", "tunnel", "net", "xport"):
            got = [u for u in p.units[1:] if LAYER.get(u.proto) == proto]
            return got[nth] if nth < len(got) else None
        return p.find(proto, nth)

    def span(self, e) -> tuple[Packet, int, int]:
        """Packet, offset and length of a located byte string."""
        _, name, slot, nth, part = e
        p, n = self.packet(self.num(self.eval(slot))), self.num(self.eval(nth))
        proto, _, member = name.partition(".")
        if name in FIELDS and FIELDS[name].kind in ("bytes", "var"):
            at, size, _, _ = p.place(name, n)
        else:
            u = self.unit(p, proto, n)
            if u is None:
                raise KeyError(name)
            a, b = {"header": (u.soff, u.poff), "payload": (u.poff, u.toff), "trailer": (u.toff, u.eoff)}.get(member, (u.soff, u.eoff))
            at, size = a, b - a
        if part is not None:
            off = self.num(self.eval(part[0]))
            want = self.num(self.eval(part[1])) if part[1] is not None else size - off
            if off + want > size:
                raise IndexError(name)
            at, size = at + off, want
        return p, at, size

    def eval(self, e):
        self.left -= 1
        if self.left < 0:
            raise PmlError("the program ran too long")
        return EVAL[e[0]](self, e)

    def _or(self, e) -> int:
        return 1 if self.truth(e[1]) else self.num(self.eval(e[2]))

    def _and(self, e) -> int:
        return self.num(self.eval(e[2])) if self.truth(e[1]) else 0

    def _unary(self, e) -> int:
        x = self.num(self.eval(e[2]))
        return (~x if e[1] == "~" else -x) & M

    def _binary(self, e) -> int:
        a, b, op = self.num(self.eval(e[2])), self.num(self.eval(e[3])), e[1]
        if op in "/%" and not b:
            raise PmlError("division by zero")
        return BINARY[op](a, b) & M

    def _compare(self, e) -> int:
        a, b, op = self.eval(e[2]), self.eval(e[3]), e[1]
        if op in ("==", "!=") and isinstance(a, bytes) and isinstance(b, bytes):
            return int((a == b) == (op == "=="))
        a, b = self.num(a), self.num(b)
        if op in ("==", "!="):
            return int((a == b) == (op == "=="))
        return int(COMPARE[op](self.signed(a), self.signed(b)))

    def _match(self, e) -> int:
        _, op, left, r = e
        v = self.eval(left)
        if r[0] == "name" and r[1] in CONSTANTS and CONSTANTS[r[1]][1]:
            r = ("mask", *CONSTANTS[r[1]])
        if r[0] == "regex":
            same = re.search(r[1].encode("latin-1"), v, re.S) is not None
        elif r[0] == "mask":
            same = len(v) == len(r[1]) and all((x ^ y) & m == 0 for x, y, m in zip(v, r[1], r[2], strict=True))
        else:
            same = v == self.eval(r)
        return int(same == (op == "=~"))

    def truth(self, e) -> bool:
        v = self.eval(e)
        return bool(v if isinstance(v, int) else self.num(v))

    def name(self, e):
        _, name, slot, nth, part = e
        scope = self.scope(name)
        if scope is not None:
            v = scope[name]
            if isinstance(v, (bytearray, Ref)) or part is not None:
                return self.ref(e).value()
            return v
        if name in std.CONSTANTS:
            return std.CONSTANTS[name]
        if name in CONSTANTS:
            return CONSTANTS[name][0]
        proto, _, member = name.partition(".")
        if proto not in PRID and proto not in ("pdu", "link", "tunnel", "net", "xport"):
            return (self.stack[-1] if self.stack else self.vars).setdefault(name, 0)
        f = FIELDS.get(name)
        if part is None and f is not None and f.kind == "bits":
            return self.packet(self.num(self.eval(slot))).get(name, self.num(self.eval(nth)))
        if part is not None or (f is not None and f.kind in ("bytes", "var")) or member in ("header", "payload", "trailer", "pdu"):
            p, at, size = self.span(e)
            return bytes(p.data[at : at + size])
        row = self.slots[self.num(self.eval(slot))]
        n = self.num(self.eval(nth))
        base = name.removesuffix(".exists")
        if base != proto and base in FIELDS and (member.endswith("exists") or FIELDS[base].kind == "whole"):
            try:
                row["__p"].place(base, n)
                return 1 if FIELDS[base].optional else row["__p"].units.index(self.unit(row["__p"], proto, n))
            except (KeyError, TypeError):
                return 0
        u = self.unit(row["__p"], proto, n) if row else None
        if member in ("", "exists", "index"):
            return row["__p"].units.index(u) if u is not None else 0
        if u is None:
            return M
        return {"hlen": u.poff - u.soff, "plen": u.toff - u.poff, "tlen": u.eoff - u.toff, "totlen": u.eoff - u.soff, "error": u.error, "prid": u.prid}[member]

    def call(self, name: str, args: list):
        if name in self.p["inlines"]:
            params, body = self.p["inlines"][name]
            self.stack.append((dict(self.stack[-1]) if self.stack else {}) | self.bound(params, args))
            try:
                return self.eval(body)
            finally:
                self.stack.pop()
        if name in self.p["functions"]:
            params, body = self.p["functions"][name]
            frame = self.bound(params, args)
            if len(self.stack) > 300:
                raise PmlError("calls nest too deeply")
            self.stack.append(frame)
            try:
                self.exec(body)
            except _Jump as j:
                if j.kind == "return":
                    return 0 if j.value is None else j.value
                raise
            finally:
                self.stack.pop()
            return 0
        if name in REFS:
            return REFS[name](self.ref(args[0]))
        if name == "str_mkref":
            return self.ref(("call", name, args)).value()
        if name in ("pkt_cut_u", "pkt_cut_d"):
            r = self.ref(args[0])
            if r.slot < 0:
                raise PmlError(f"{name} needs bytes of a packet")
            r.home.cut_bytes(r.at, r.size)
            return 0
        if name in std.CALLS:
            return std.CALLS[name](self, args)
        if name in ("fix_len", "fix_csum", "pdu_delete", "pdu_insert", "pdu_update"):
            _, loc, slot, nth, _ = args[0]
            p = self.packet(self.num(self.eval(slot)))
            u = self.unit(p, loc, self.num(self.eval(nth)))
            if name == "pdu_insert":
                p.insert(self.num(self.eval(args[1])), 0 if loc in ("pkt",) or u is None else p.units.index(u))
            elif u is None:
                raise KeyError(loc)
            elif name == "pdu_delete":
                p.delete(p.units.index(u))
            elif name == "pdu_update":
                p.parse()
            else:
                (p.fix_lens if name == "fix_len" else p.fix_csums)(u)
            return 0
        v = [self.eval(a) for a in args]
        n = [self.num(x) for x in v]
        if name.startswith("meta_get_"):
            return self.tag_value(n[0], TAGS[name[9:]])
        if name.startswith("meta_set_"):
            row = self.slots[n[0]]
            if name == "meta_set_ts":
                row["ts_sec"], row["ts_nsec"] = (None, None) if n[1] == M else (n[1], n[2])
            else:
                row[TAGS[name[9:]]] = None if n[1] == M else n[1]
            return 0
        if name.startswith("meta_"):
            return self.meta(name, n)
        if name not in PLAIN:
            raise PmlError(f"unknown function {name}")
        return PLAIN[name](self, n) or 0

    def meta(self, name: str, n: list[int]) -> int:
        """Tags by type: has, add, remove, and big-endian reads and writes of a tag's bytes (writes from byte 2 on)."""
        slot, kind = n[0], n[1]
        row = self.slots[slot]
        if name == "meta_add_info":
            put_tag(row, tag(APPINFO, 0, bytes(4 * n[1])))
            return 0
        raw, at = self.tag_bytes(slot, kind)
        if name == "meta_has":
            return int(raw is not None)
        if name == "meta_add":
            if raw is not None and kind < TAG["parseinfo"]:
                raise PmlError(f"tag {kind} is there already")
            if kind not in EMPTY_TAG and kind < APPINFO:
                raise PmlError(f"no tag of type {kind}")
            put_tag(row, EMPTY_TAG.get(kind) or tag(kind))
            return 0
        if raw is None:
            raise PmlError(f"no tag of type {kind}")
        if name == "meta_rem":
            if kind in TAG_COLUMN:
                row[TAG_COLUMN[kind]] = None
                if kind == TAG["timestamp"]:
                    row["ts_nsec"] = None
            else:
                column = "parseinfo" if kind == TAG["parseinfo"] else "appinfo"
                row[column] = [x for k, x in enumerate(row[column]) if k != at] or None
            return 0
        size, off = int(name.removeprefix("meta_rd").removeprefix("meta_wr")) // 8, n[2]
        if off + size > len(raw) or (name.startswith("meta_wr") and off < 2):
            raise IndexError(f"byte {off} of tag {kind}")
        if name.startswith("meta_rd"):
            return int.from_bytes(raw[off : off + size], "big")
        put_tag(row, raw[:off] + (n[3] & ((1 << 8 * size) - 1)).to_bytes(size, "big") + raw[off + size :], at)
        return 0

    def bound(self, params: list[tuple[str, str]], args: list) -> dict:
        """Arguments by parameter; byte strings are passed as references."""
        return {k: self.ref(a) if kind == "str" else self.eval(a) for (k, kind), a in zip(params, args, strict=True)}

    def assign(self, target, value) -> None:
        _, name, slot, nth, part = target
        scopes = ([self.stack[-1]] if self.stack else []) + [self.vars]
        holder = next((s for s in scopes if name in s), None)
        proto = name.split(".")[0]
        if holder is None and (proto in PRID or proto == "pdu"):
            f = FIELDS.get(name)
            if part is None and f is not None and f.kind != "whole":
                self.packet(self.num(self.eval(slot))).set(name, value, self.num(self.eval(nth)))
            else:
                self.ref(target).put(value)
            return
        holder = holder if holder is not None else scopes[0]
        held = holder.get(name)
        if isinstance(held, (bytearray, Ref)) and (part is not None or held.size if isinstance(held, Ref) else True):
            self.ref(target).put(value)
        elif isinstance(held, Ref):
            holder[name] = bytearray(value if isinstance(value, bytes) else value.to_bytes(4, "big"))
        else:
            holder[name] = value if isinstance(value, int) else self.num(value)

    def refer(self, name: str, e) -> None:
        """Make a variable another name of the bytes that e names."""
        holder = next((s for s in ([self.stack[-1]] if self.stack else []) + [self.vars] if name in s), None)
        (holder if holder is not None else self.stack[-1] if self.stack else self.vars)[name] = self.ref(e)

    def show(self, fmt, v) -> str:
        kind, width = fmt or ("s" if isinstance(v, bytes) else "d", "")
        n = self.num(v)
        raw = v if isinstance(v, bytes) else v.to_bytes(4, "big")
        s = SHOW[kind](n, raw)
        if not width:
            return s
        w = int(width.strip("+-") or 0)
        return s.rjust(w) if "+" in width else s.ljust(w)

    def exec(self, s) -> None:
        kind = s[0]
        if kind == "block":
            for x in s[1]:
                self.exec(x)
        elif kind == "declare":
            self.declare(s)
        elif kind == "assign":
            self.assign(s[1], self.eval(s[2]))
        elif kind == "refer":
            self.refer(s[1], s[2])
        elif kind == "do":
            self.eval(s[1])
        elif kind == "if":
            if self.truth(s[1]):
                self.exec(s[2])
            elif s[3] is not None:
                self.exec(s[3])
        elif kind == "while":
            while self.truth(s[1]):
                try:
                    self.exec(s[2])
                except _Jump as j:
                    if j.kind == "break":
                        break
                    if j.kind != "continue":
                        raise
        elif kind == "print":
            self.line += "".join([self.show(f, self.eval(e)) for f, e in s[1]])
            if s[2]:
                self.text.append(self.line)
                self.line = ""
        elif kind in ("send", "drop") and s[1] is None:
            raise _Jump(f"{kind}all")
        elif kind in ("send", "send_no_free", "drop"):
            slot = self.num(self.eval(s[1]))
            if kind != "drop":
                self.emit(self.slots[slot])
            if kind != "send_no_free":
                self.slots[slot] = None
        else:
            raise _Jump(kind, self.eval(s[1]) if kind == "return" and s[1] is not None else None)

    def emit(self, row: dict | None) -> None:
        if row is not None:
            self.out.append({k: v for k, v in row.items() if k != "__p"} | {"data": bytes(row["__p"].data), "dltype": row["__p"].dltype})

    def _all(self, send: bool) -> None:
        for k in sorted(self.slots):
            if send:
                self.emit(self.slots[k])
        self.slots.clear()

    def _run(self, rules) -> bool:
        """Rules in order; False when the program exits."""
        self.stack.append({})
        self.left = self.budget
        try:
            for test, body in rules:
                if test is None or self.truth(test):
                    try:
                        self.exec(body)
                    except _Jump as j:
                        if j.kind == "nextrule":
                            continue
                        if j.kind in ("sendall", "dropall"):
                            self._all(j.kind == "sendall")
                            return True
                        if j.kind == "exit":
                            return False
                        raise
            return True
        finally:
            self.stack.pop()

    def entry(self, which: str) -> bool:
        ok = self._run([(None, b) for b in self.p[which]])
        self.slots.clear()
        return ok

    def feed(self, row: dict) -> bool:
        self.slots[0] = row | {"__p": Packet(row["data"], int(row["dltype"]))}
        try:
            ok = self._run(self.p["rules"])
        except (KeyError, IndexError):
            if self.on_error == "abort":
                raise
            self.slots.clear()
            return True
        self._all(ok)
        return ok


    def tick_until(self, now: float | None, period: float) -> bool:
        """Run TICK for every period that has passed since the last one; the first packet's time starts the clock."""
        if now is None or not self.p["TICK"]:
            return True
        if self.next_tick is None:
            self.next_tick = now + period
        while self.next_tick <= now:
            if not self.entry("TICK"):
                return False
            self.next_tick += period
        return True


def _take(m: Machine, n: list[int]) -> None:
    m.slots[n[1]] = m.lists[n[0]].popleft() if m.lists[n[0]] else None


def _append(m: Machine, n: list[int], left: bool) -> None:
    (m.lists[n[0]].appendleft if left else m.lists[n[0]].append)(m.slots[n[1]])
    m.slots[n[1]] = None


def _exit(m: Machine, n: list[int]) -> None:
    raise _Jump("exit", n[0])


def _swap(m: Machine, n: list[int]) -> None:
    m.slots[n[0]], m.slots[n[1]] = m.slots[n[1]], m.slots[n[0]]


def _copy(m: Machine, n: list[int]) -> None:
    row = m.slots[n[1]]
    m.slots[n[0]] = row if row is None else {k: v.copy() if k == "__p" else copy.deepcopy(v) if isinstance(v, list) else v for k, v in row.items()}


def _fix_dltype(m: Machine, n: list[int]) -> None:
    p = m.packet(n[0])
    p.dltype = p.units[1].prid if len(p.units) > 1 else RAW


def _offset(m: Machine, n: list[int]) -> int:
    got = m.packet(n[0]).get_offset(*n[1:])
    return M if got is None else got


#: Values by the kind of node.
EVAL = {
    "int": lambda m, e: e[1], "bytes": lambda m, e: e[1], "regex": lambda m, e: e[1], "prid": lambda m, e: PRID[e[1]], "or": Machine._or, "and": Machine._and,
    "not": lambda m, e: int(not m.truth(e[1])), "unary": Machine._unary, "binary": Machine._binary, "compare": Machine._compare, "match": Machine._match,
    "call": lambda m, e: m.call(e[1], e[2]), "name": Machine.name,
}
BINARY = {
    "+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.floordiv, "%": operator.mod, "&": operator.and_, "|": operator.or_, "^": operator.xor,
    "<<": lambda a, b: a << (b & 31), ">>": lambda a, b: a >> (b & 31),
}
COMPARE = {"<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}
REFS = {"str_addr": lambda r: r.at, "str_ispkt": lambda r: int(r.slot >= 0), "str_seg": lambda r: max(r.slot, 0), "str_len": lambda r: r.size, "str_isnull": lambda r: int(not r.size)}
#: Functions of numbers, by name; those that give nothing are 0.
PLAIN = {
    "pop": lambda m, n: n[0].bit_count(), "log2": lambda m, n: (n[0].bit_length() - 1) & M,
    "min": lambda m, n: min(n, key=m.signed), "max": lambda m, n: max(n, key=m.signed), "pkt_nlists": lambda m, n: 256, "pkt_lempty": lambda m, n: int(not m.lists[n[0]]),
    "pkt_enq": lambda m, n: _append(m, n, False), "pkt_push": lambda m, n: _append(m, n, True), "pkt_deq": _take, "pkt_pop": _take, "pkt_swap": _swap, "pkt_copy": _copy, "exit": _exit,
    "pkt_new": lambda m, n: m.new_packet(n[0], n[1]) and 0, "pkt_new_z": lambda m, n: m.new_packet(n[0], 0) and 0, "pkt_parse": lambda m, n: m.packet(n[0]).parse(),
    "pkt_get_off": _offset, "pkt_adj_off": lambda m, n: m.packet(n[0]).adjust_offset(*n[1:4], m.signed(n[4])), "fix_dltype": _fix_dltype,
    "fix_lens": lambda m, n: m.packet(n[0]).fix_lens(), "fix_csums": lambda m, n: m.packet(n[0]).fix_csums() and 0,
    "pkt_ins_u": lambda m, n: m.packet(n[0]).insert_bytes(n[1], n[2], b"U"), "pkt_ins_d": lambda m, n: m.packet(n[0]).insert_bytes(n[1], n[2], b"D"),
}
#: A number and its bytes as text.
SHOW = {
    "d": lambda n, raw: str(n - (1 << 32) if n >> 31 else n), "u": lambda n, raw: str(n), "x": lambda n, raw: f"{n:x}", "o": lambda n, raw: f"{n:o}", "b": lambda n, raw: f"{n:b}",
    "s": lambda n, raw: raw.decode("latin-1"), "hex": lambda n, raw: raw.hex(), "ip": lambda n, raw: str(ipaddress.IPv4Address(raw[:4])), "ip6": lambda n, raw: str(ipaddress.IPv6Address(raw[:16])), "eth": lambda n, raw: raw.hex(":"),
}


def seconds(row: dict) -> float | None:
    return None if row.get("ts_sec") is None else row["ts_sec"] + (row.get("ts_nsec") or 0) / 1e9


def run(packets: DataFrame, text: str, key: str | None = None, load=None, on_error: str = "abort", tick: float = TICK) -> DataFrame:
    """Packets that a program sends, with ``sub_no`` for their order and ``printed`` text on rows of their own.

    Every key's packets (or all, when key is None) are one stream in (src_id, pkt_no) order, which passes through
    the interpreter a batch at a time. Where no packet's run depends on an earlier one's (``state.independent``), packets
    are taken as they come, in any number of tasks, and counted afterwards. A stream's
    time is that of its packets' timestamps: before each packet TICK runs once for every ``tick`` seconds
    that have passed, so give a longer period where packets are far apart.
    """
    program = parse(text, load)
    own = [T.StructField(f.name, f.dataType) for f in packets.schema]
    numbered, printed = T.StructField("sub_no", T.LongType()), T.StructField("printed", T.StringType())
    names = packets.columns
    by = F.col(key) if key else F.lit(0)
    place = [F.asc_nulls_last(c) for c in ("src_id", "pkt_no") if c in names]
    if independent(program, on_error):
        return _each(packets.withColumn("__k", by), names, program, on_error, place, own, printed)
    schema = T.StructType([*own, numbered, printed])

    def fit(batches):
        for rows in _streams(batches):
            m, out, sent = Machine(program, on_error), [], 0

            def drain():
                out.extend(m.out)
                out.extend({"printed": line} for line in m.text)
                m.out, m.text = [], []

            def made(out=out):
                nonlocal sent
                for r in out:
                    r["sub_no"], sent = sent, sent + 1
                yield from table_of(out, schema).to_batches()
                out.clear()

            go = m.entry("BEGIN")
            for row in rows if go else []:
                if not m.tick_until(seconds(row), tick) or not m.feed(row):
                    break
                drain()
                if len(out) >= ROWS:
                    yield from made()
            if go:
                m.entry("END")
            drain()
            yield from made()

    return packets.withColumn("__k", by).repartition("__k").sortWithinPartitions("__k", *place).mapInArrow(fit, schema)


def _streams(batches):
    """The rows of each key in turn, from batches sorted by key; what is left of a key's rows when the next is asked for is skipped."""

    def all_rows():
        for batch in batches:
            yield from rows_of(batch)

    rows = all_rows()
    held = [next(rows, None)]

    def own(k):
        while held[0] is not None and (held[0]["__k"] == k or (k != k and held[0]["__k"] != held[0]["__k"])):
            row = held[0]
            held[0] = next(rows, None)
            del row["__k"]
            yield row

    while held[0] is not None:
        stream = own(held[0]["__k"])
        yield stream
        for _ in stream:
            pass


def _each(keyed: DataFrame, names: list[str], program: dict, on_error: str, place: list, own: list, printed: T.StructField) -> DataFrame:
    """Every packet through the program on its own. Numbers in a key's stream come from a window, which Spark leaves out where nobody asks for them."""
    at = [c for c in ("src_id", "pkt_no") if c in names]
    marks = [T.StructField("__k", keyed.schema["__k"].dataType), *[T.StructField(f"__{c}", keyed.schema[c].dataType) for c in at], T.StructField("__j", T.IntegerType())]
    schema = T.StructType([*own, *marks, printed])

    def fit(batches):
        m, out = Machine(program, on_error), []
        for batch in batches:
            for row in rows_of(batch):
                mark = {"__k": row.pop("__k")} | {f"__{c}": row[c] for c in at}
                m.feed(row)
                for j, r in enumerate([*m.out, *[{"printed": line} for line in m.text]]):
                    r.update(mark)
                    r["__j"] = j
                    out.append(r)
                m.out, m.text = [], []
                if len(out) >= ROWS:
                    yield from table_of(out, schema).to_batches()
                    out = []
        yield from table_of(out, schema).to_batches()

    w = Window.partitionBy("__k").orderBy(*[F.asc_nulls_last(f"__{c}") for c in at], "__j")
    rows = keyed.mapInArrow(fit, schema).withColumn("sub_no", (F.row_number().over(w) - 1).cast("long"))
    return rows.select(*names, "sub_no", "printed")

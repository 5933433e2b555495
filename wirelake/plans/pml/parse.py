"""Text to tree. Nodes are tuples: (kind, ...)."""

from __future__ import annotations

import ipaddress
import re

TOKEN = re.compile(
    r"""(?P<ws>\s+|\#[^\n]*)
  |(?P<mac>[0-9a-fA-F]{1,2}(?::[0-9a-fA-F]{1,2}){5}(?![0-9a-fA-F:]))
  |(?P<ip6>(?:[0-9a-fA-F]{1,4}:){1,7}(?::[0-9a-fA-F]{1,4})*(?:[0-9a-fA-F]{1,4})?|::[0-9a-fA-F:]*)
  |(?P<ip>\d+\.\d+\.\d+\.\d+)
  |(?P<num>0[xX][0-9a-fA-F]+|0b[01]+|\d+)
  |(?P<str>"(?:\\.|[^"\\])*")
  |(?P<hex>(?:\\x[0-9a-fA-F]{2})+)
  |(?P<rex>`[^`]*`)
  |(?P<op>\?-|-\?|=~|!~|==|!=|<=|>=|<<|>>|[-+*/%&|^~<>=(){}\[\],;@$!])
  |(?P<name>[A-Za-z_][\w.]*)""",
    re.X,
)
ESCAPES = {"n": b"\n", "t": b"\t", "r": b"\r", "0": b"\0", "\\": b"\\", '"': b'"'}
COMPARE = {"==", "!=", "<", ">", "<=", ">=", "=~", "!~"}
LEVELS = [("|",), ("^",), ("&",), ("+", "-"), ("*", "/", "%"), ("<<", ">>")]
KEYWORDS = {"if", "else", "while", "return", "break", "continue", "nextrule", "send", "send_no_free", "drop", "print"}


class PmlError(ValueError):
    """A program that can't be read or run."""


def text_bytes(quoted: str) -> bytes:
    out, at = b"", 1
    while at < len(quoted) - 1:
        c = quoted[at]
        if c == "\\" and quoted[at + 1] == "x":
            out, at = out + bytes([int(quoted[at + 2 : at + 4], 16)]), at + 4
        elif c == "\\":
            out, at = out + ESCAPES.get(quoted[at + 1], quoted[at + 1].encode()), at + 2
        else:
            out, at = out + c.encode(), at + 1
    return out


def tokens(text: str) -> list[tuple[str, object]]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise PmlError(f"can't read {text[at : at + 20]!r}")
        kind, word, at = m.lastgroup, m[0], m.end()
        if kind == "ws":
            continue
        value = {
            "mac": lambda w: bytes(int(x, 16) for x in w.split(":")), "ip": lambda w: ipaddress.IPv4Address(w).packed,
            "ip6": lambda w: ipaddress.IPv6Address(w).packed, "num": lambda w: int(w, 0) if not re.fullmatch(r"0\d+", w) else int(w), "str": text_bytes,
            "hex": lambda w: bytes.fromhex(w.replace("\\x", "")), "rex": lambda w: w[1:-1],
        }.get(kind, lambda w: w)(word)
        out.append((kind, value))
    return [*out, ("end", None)]


class Parser:
    def __init__(self, text: str, load=None):
        self.t, self.at, self.load = tokens(text), 0, load

    def peek(self, k: int = 0):
        return self.t[min(self.at + k, len(self.t) - 1)][1]

    def kind(self, k: int = 0):
        return self.t[min(self.at + k, len(self.t) - 1)][0]

    def take(self, want=None):
        kind, value = self.t[self.at]
        if want is not None and value != want:
            raise PmlError(f"expected {want!r}, found {value!r}")
        self.at += 1
        return value

    def maybe(self, want) -> bool:
        if self.kind() in ("op", "name") and self.peek() == want:
            self.at += 1
            return True
        return False

    # expressions, weakest first
    def expression(self):
        left = self.conjunction()
        while self.maybe("or"):
            left = ("or", left, self.conjunction())
        return left

    def conjunction(self):
        left = self.comparison()
        while self.maybe("and"):
            left = ("and", left, self.comparison())
        return left

    def comparison(self):
        left = self.binary(0)
        if self.kind() == "op" and self.peek() in COMPARE:
            op = self.take()
            right = self.binary(0)
            if op in ("=~", "!~"):
                if right[0] == "binary" and right[1] == "/" and right[2][0] == "bytes":
                    right = ("mask", right[2][1], self.mask_of(right[2][1], right[3]))
                return ("match", op, left, right)
            return ("compare", op, left, right)
        return left

    @staticmethod
    def mask_of(value: bytes, m) -> bytes:
        if m[0] == "int":
            n = len(value) * 8
            return (((1 << n) - 1) >> (n - m[1]) << (n - m[1])).to_bytes(len(value), "big") if m[1] else bytes(len(value))
        return m[1]

    def binary(self, level: int):
        if level == len(LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while self.kind() == "op" and self.peek() in LEVELS[level]:
            left = ("binary", self.take(), left, self.binary(level + 1))
        return left

    def unary(self):
        if self.maybe("not"):
            return ("not", self.primary())
        for op in ("~", "-"):
            if self.kind() == "op" and self.peek() == op:
                self.take()
                return ("unary", op, self.primary())
        return self.primary()

    def primary(self):
        kind = self.kind()
        if kind == "num":
            return ("int", self.take() & 0xFFFFFFFF)
        if kind in ("str", "hex", "ip", "ip6", "mac"):
            return ("bytes", self.take())
        if kind == "rex":
            return ("regex", self.take())
        if self.maybe("("):
            e = self.expression()
            self.take(")")
            return e
        if self.maybe("@"):
            return ("prid", self.take())
        return self.locator()

    def locator(self):
        slot, nth = ("int", 0), ("int", 0)
        if self.maybe("$"):
            self.take("(")
            slot = self.expression()
            if self.maybe(","):
                nth = self.expression()
            self.take(")")
        if self.kind() != "name":
            raise PmlError(f"expected a value, found {self.peek()!r}")
        name = self.take()
        if self.maybe("("):
            args = []
            while not self.maybe(")"):
                args.append(self.expression())
                self.maybe(",")
            return ("call", name, args)
        part = None
        if self.maybe("["):
            off = self.expression()
            part = (off, self.expression() if self.maybe(",") else None)
            self.take("]")
        return ("name", name, slot, nth, part)

    # statements
    def block(self):
        self.take("{")
        out = []
        while not self.maybe("}"):
            out.append(self.statement())
        return ("block", out)

    def statement(self):
        if self.kind() == "op" and self.peek() == "{":
            return self.block()
        word = self.peek() if self.kind() == "name" else None
        if word == "if":
            self.take()
            self.take("(")
            test = self.expression()
            self.take(")")
            yes = self.statement()
            return ("if", test, yes, self.statement() if self.maybe("else") else None)
        if word == "while":
            self.take()
            self.take("(")
            test = self.expression()
            self.take(")")
            return ("while", test, self.statement())
        if word in ("int", "str", "global"):
            if word == "global":
                self.take()
                return self.declaration("global")
            return self.declaration("local")
        if word in ("break", "continue", "nextrule"):
            self.take()
            self.take(";")
            return (word,)
        if word in ("return", "send", "send_no_free", "drop"):
            self.take()
            value = None if self.kind() == "op" and self.peek() == ";" else self.expression()
            self.take(";")
            return (word, value)
        if word == "print":
            return self.printing()
        if self.kind() == "op" and self.peek() == "&":
            self.take()
            name = self.take()
            self.take("=")
            value = self.expression()
            self.take(";")
            return ("refer", name, value)
        target = self.expression()
        if self.maybe("="):
            value = self.expression()
            self.take(";")
            return ("assign", target, value)
        self.take(";")
        return ("do", target)

    def printing(self):
        self.take("print")
        items, newline = [], True
        while not self.maybe(";"):
            fmt = None
            if self.kind() == "op" and self.peek() == "%":
                self.take()
                width = ""
                while self.kind() == "num" or (self.kind() == "op" and self.peek() in "+-"):
                    width += str(self.take())
                fmt = (str(self.take()), width)
                self.take("%")
            items.append((fmt, self.expression()))
            newline = True
            if self.maybe(","):
                newline = False
        return ("print", items, newline)

    def declaration(self, scope: str):
        kind, name, size, value = self.take(), self.take(), None, None
        if self.maybe("["):
            size = None if self.peek() == "]" else self.expression()
            self.take("]")
        if self.maybe("="):
            value = self.expression()
        self.take(";")
        return ("declare", scope, kind, name, size, value)

    def parameters(self) -> list[tuple[str, str]]:
        """(name, type) of each; a parameter without a type is an int."""
        self.take("(")
        out = []
        while not self.maybe(")"):
            kind = self.take() if self.peek(1) not in (",", ")") else "int"
            out.append((self.take(), kind))
            self.maybe(",")
        return out

    def program(self) -> dict:
        p = {"consts": [], "globals": [], "functions": {}, "inlines": {}, "BEGIN": [], "TICK": [], "END": [], "rules": []}
        while self.kind() != "end":
            word = self.peek()
            if self.maybe("import"):
                name = self.take()
                self.take(";")
                if bytes(name if isinstance(name, bytes) else name.encode()).split(b".")[0] == b"std":
                    continue
                if self.load is None:
                    raise PmlError("no library folder is given")
                sub = Parser(self.load(name.decode() if isinstance(name, bytes) else name), self.load).program()
                for k, v in sub.items():
                    p[k] = {**p[k], **v} if isinstance(v, dict) else p[k] + v
            elif word in ("BEGIN", "TICK", "END"):
                self.take()
                p[word].append(self.block())
            elif self.maybe("const"):
                name = self.take()
                self.take("=")
                p["consts"].append((name, self.expression()))
                self.take(";")
            elif self.maybe("inline"):
                name = self.take()
                params = self.parameters()
                self.take("{")
                body = self.expression()
                self.maybe(";")
                self.take("}")
                p["inlines"][name] = (params, body)
            elif word in ("int", "str", "void") and self.kind(2) == "op" and self.peek(2) == "(":
                self.take()
                name = self.take()
                params = self.parameters()
                if self.maybe(";"):
                    continue
                p["functions"][name] = (params, self.block())
            elif word in ("int", "str"):
                p["globals"].append(self.declaration("global"))
            elif self.maybe("?-"):
                test = self.expression()
                self.take("-?")
                p["rules"].append((test, self.block()))
            else:
                p["rules"].append((None, self.block()))
        return p


def parse(text: str, load=None) -> dict:
    """A program; load(name) gives the text of an imported library. The standard library is always there."""
    return Parser(text, load).program()


def parse_expression(text: str):
    p = Parser(text)
    out = p.expression()
    if p.kind() != "end":
        raise PmlError(f"unexpected {p.peek()!r}")
    return out

"""Columns over bytes: big-endian integers, bit fields, masks, splices, checksums, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U32 = 0xFFFFFFFF


def cut(data: Column, off: Column | int, n: Column | int) -> Column:
    """n bytes from a 0-based offset; shorter where the data ends."""
    return F.substring(data, F.lit(off) + 1 if isinstance(off, int) else off + 1, F.lit(n) if isinstance(n, int) else n)


def be_uint(data: Column, off: Column | int = 0, n: int = 4) -> Column:
    """The unsigned big-endian number in up to 7 bytes; null past the end."""
    part = cut(data, off, n)
    return F.when(F.length(part) == n, F.conv(F.hex(part), 16, 10).cast("long"))


def first_uint(value: Column) -> Column:
    """A byte string as an integer: its first four bytes, big-endian; empty is 0."""
    part = F.substring(value, 1, 4)
    return F.when(F.length(part) == 0, F.lit(0).cast("long")).otherwise(F.conv(F.hex(part), 16, 10).cast("long"))


def bits(data: Column, off: Column | int, bit: int, n: int) -> Column:
    """n bits (at most 32) that start at a bit of the byte at off."""
    width = (bit + n + 7) // 8
    return F.shiftright(be_uint(data, off, width), width * 8 - bit - n).bitwiseAND((1 << n) - 1)


def u32(x: Column) -> Column:
    return x.cast("long").bitwiseAND(U32)


def s32(x: Column) -> Column:
    """An unsigned 32-bit value read as signed."""
    return F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x)


def mask_eq(value: Column, want: bytes, mask: bytes) -> Column:
    """Equal length, and equal under the mask, eight bytes at a time."""
    tests = F.length(value) == len(want)
    for at in range(0, len(want), 4):
        m = int.from_bytes(mask[at : at + 4], "big")
        w = int.from_bytes(want[at : at + 4], "big") & m
        tests = tests & (be_uint(value, at, len(want[at : at + 4])).bitwiseAND(m) == w)
    return F.coalesce(tests, F.lit(False))


def cidr_eq(value: Column, network: str) -> Column:
    """Does an address lie in a network such as 10.0.0.0/8?"""
    import ipaddress

    net = ipaddress.ip_network(network, strict=False)
    return mask_eq(value, net.network_address.packed, net.netmask.packed)


def regex_match(value: Column, pattern: str) -> Column:
    """Unanchored search over bytes, each byte one character."""
    return F.decode(value, "ISO-8859-1").rlike(f"(?s){pattern}")


def be_bytes(x: Column, n: int) -> Column:
    """The low n bytes of a number, big-endian."""
    return F.unhex(F.right(F.lpad(F.hex(x.cast("long")), 16, "0") if n <= 8 else F.hex(x), F.lit(2 * n)))


def splice(data: Column, off: Column | int, value: Column, n: int) -> Column:
    """data with n bytes at off replaced."""
    at = F.lit(off) if isinstance(off, int) else off
    return F.concat(F.substring(data, F.lit(1), at), value, F.substring(data, at + n + 1, F.length(data)))


def ones_sum(data: Column) -> Column:
    """The 16-bit ones-complement sum of bytes, an odd last byte padded with zero."""
    even = F.when(F.length(data) % 2 == 1, F.concat(data, F.lit(b"\0"))).otherwise(data)
    words = F.when(F.length(even) > 0, F.transform(F.sequence(F.lit(0), F.length(even) - 2, F.lit(2)), lambda i: F.conv(F.hex(F.substring(even, i + 1, F.lit(2))), 16, 10).cast("long")))
    total = F.aggregate(F.coalesce(words, F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda a, x: a + x)
    return (total - 1) % 0xFFFF + 1


def fmt_ip(value: Column) -> Column:
    return F.concat_ws(".", *[be_uint(value, k, 1).cast("string") for k in range(4)])


def fmt_eth(value: Column) -> Column:
    return F.lower(F.concat_ws(":", *[F.hex(cut(value, k, 1)) for k in range(6)]))


def fmt_ip6(value: Column) -> Column:
    """Eight groups without leading zeros, the first longest run of two or more zero groups shortened."""
    full = F.concat_ws(":", *[F.lower(F.hex(be_uint(value, k, 2))) for k in range(0, 16, 2)])
    out = full
    for n in range(2, 9):
        zeros = ":".join(["0"] * n)
        short = F.regexp_replace(full, rf"^(|.*?:){zeros}(:.*|)$", "$1::$2")
        out = F.when(full.rlike(rf"(^|:){zeros}(:|$)"), F.regexp_replace(short, ":{3,}", "::")).otherwise(out)
    return out


def pop_count(x: Column) -> Column:
    return F.bit_count(u32(x)).cast("long")


def log2(x: Column) -> Column:
    """The place of the highest bit; -1 (as unsigned) for 0."""
    return F.when(u32(x) == 0, F.lit(U32).cast("long")).otherwise((F.length(F.bin(u32(x))) - 1).cast("long"))

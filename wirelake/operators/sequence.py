"""Sequence numbers written into packets and read back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelake.functions.bytesx import be_bytes, be_uint, splice
from wirelake.functions.fields import unit
from wirelake.operators.order import running


@dataclass(frozen=True)
class Location:
    """Where a number goes: esrc, edst, ipid, ipsrc, ipdst, v6fid, tpld, upld, ipld or i6pld [off, size]."""

    kind: str
    off: int = 0
    size: int = 4

    def places(self) -> list[tuple[Column, int]]:
        """(start, bytes) of each form; start is null where it doesn't apply."""
        eth, ip, ip6 = unit("eth"), unit("ip"), unit("ip6")
        fixed = {
            "esrc": [(eth["soff"] + 8, 4)], "edst": [(eth["soff"] + 2, 4)], "ipid": [(ip["soff"] + 4, 2)],
            "ipsrc": [(ip["soff"] + 12, 4), (ip6["soff"] + 16, 8)], "ipdst": [(ip["soff"] + 16, 4), (ip6["soff"] + 32, 8)],
            "v6fid": [(ip6["soff"] + 1, 3)],
        }
        if self.kind in fixed:
            return fixed[self.kind]
        u = unit({"tpld": "tcp", "upld": "udp", "ipld": "ip", "i6pld": "ip6"}[self.kind])
        return [(F.when(u["poff"] + self.off + self.size <= u["toff"], u["poff"] + self.off), self.size)]


def _value(kind: str, start: Column, n: int) -> Column:
    x = be_uint(F.col("data"), start, min(n, 7)) if n < 8 else be_uint(F.col("data"), start + 1, 7)
    return x.bitwiseAND(0xFFFFF) if kind == "v6fid" else x


def embed(packets: DataFrame, locations: list[Location], start: int = 1, only: bool = False) -> DataFrame:
    """Number the packets that have one of the locations (the first in order) from start. Needs ``pdus``.

    Adds embedded, the number, null for the others; ``only`` drops those.
    """
    all_places = [(x.kind, at, n) for x in locations for at, n in x.places()]
    hit = F.coalesce(*[F.when(at.isNotNull(), F.lit(k)) for k, (_, at, _) in enumerate(all_places)])
    rows = running(packets.withColumn("__hit", hit), F.when(F.col("__hit").isNotNull(), 1).otherwise(0), "__n")
    seq = F.col("__n") + (start - 1)
    data = F.col("data")
    for k, (kind, at, n) in enumerate(all_places):
        value = seq.bitwiseAND((1 << 8 * min(n, 7)) - 1)
        if kind == "v6fid":
            value = be_uint(F.col("data"), at, 3).bitwiseAND(0xF00000).bitwiseOR(seq.bitwiseAND(0xFFFFF))
        data = F.when(F.col("__hit") == k, splice(F.col("data"), at, be_bytes(value, n), n)).otherwise(data)
    out = rows.withColumn("embedded", F.when(F.col("__hit").isNotNull(), seq)).withColumn("data", data)
    if only:
        out = out.where("__hit is not null")
    return out.drop("__hit", "__n")


def extract(packets: DataFrame, locations: list[Location], only: bool = False) -> DataFrame:
    """Read numbers back into the seq tag. Needs ``pdus``."""
    found = F.coalesce(*[_value(x.kind, at, n) for x in locations for at, n in x.places()])
    out = packets.withColumn("seq", found)
    return out.where("seq is not null") if only else out


def verify(packets: DataFrame, start: int = 1) -> DataFrame:
    """Add expected and ok: are the seq tags of the packets that have one consecutive from start?"""
    numbered = running(packets.where("seq is not null"), F.lit(1), "__n")
    return numbered.withColumn("expected", F.col("__n") + (start - 1)).withColumn("ok", F.col("seq") == F.col("expected")).drop("__n")

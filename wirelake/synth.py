"""Packets made from the events table; every value is a plain expression of its columns."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelake.functions.bytesx import be_bytes
from wirelake.functions.dissect import fixed
from wirelake.schema import ETH, PACKET

PORTS = {"click": 80, "view": 443, "purchase": 8080, "signup": 53}
CODES = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def spread(rows: DataFrame, by: str) -> DataFrame:
    """Rows dealt over as many tasks as can run, however few parts their files have: for work that costs more than a shuffle."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), by)


def packets(spark: SparkSession, sf_dir: str, checksums: bool = False, even: bool = False) -> DataFrame:
    """One packet per event: TCP for click, view, purchase; UDP for signup; ICMP echo for error.

    Odd events travel from server to client. ``even`` spreads the events over all tasks first.
    """
    kind = F.col("event_type")
    code = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in CODES.items()])
    port = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in PORTS.items()], F.lit(0))
    back = F.col("event_id") % 2 == 1
    u16 = lambda x: be_bytes(x, 2)
    client, server = be_bytes(F.lit(10 << 24) + F.col("user_id"), 4), be_bytes(F.lit((192 << 24) + (168 << 16)) + code, 4)
    cport, sport = u16(F.lit(1024) + F.col("user_id") % 60000), u16(port)
    cmac, smac = F.concat(F.lit(b"\x02\x00"), be_bytes(F.col("user_id"), 4)), F.concat(F.lit(b"\x02\x01"), be_bytes(code, 4))
    pick = lambda a, b: F.when(back, b).otherwise(a)
    body = F.encode("props", "UTF-8")
    proto = F.when(kind == "signup", 17).when(kind == "error", 1).otherwise(6)
    ports = F.concat(pick(cport, sport), pick(sport, cport))
    hlen = F.when(proto == 6, 20).otherwise(8)
    tcp = F.concat(ports, be_bytes(F.col("event_id"), 4), F.lit(b"\0\0\0\0\x50\x18\x20\0\0\0\0\0"))
    udp = F.concat(ports, u16(F.lit(8) + F.length(body)), F.lit(b"\0\0"))
    icmp = F.concat(pick(F.lit(b"\x08\0"), F.lit(b"\0\0")), F.lit(b"\0\0"), u16(F.col("user_id")), u16(F.col("event_id")))
    total = F.lit(20) + hlen + F.length(body)
    start = F.concat(F.lit(b"\x45\0"), u16(total), u16(F.col("event_id")), F.lit(b"\0\0\x40"), be_bytes(proto, 1))
    ends = F.concat(pick(client, server), pick(server, client))
    # the header's 16-bit words are numbers at hand; their sum doesn't depend on which end sends
    word = lambda x, k: F.shiftright(x, k).bitwiseAND(0xFFFF)
    own, other = F.lit(10 << 24) + F.col("user_id"), F.lit((192 << 24) + (168 << 16)) + code
    words = [F.lit(0x4500), word(total, 0), word(F.col("event_id"), 0), F.lit(0x4000) + proto, word(own, 16), word(own, 0), word(other, 16), word(other, 0)]
    check = u16(F.lit(0xFFFE) - (reduce(operator.add, words) - 1) % 0xFFFF) if checksums else F.lit(b"\0\0")
    eth = F.concat(pick(smac, cmac), pick(cmac, smac), F.lit(b"\x08\0"))
    data = F.concat(eth, start, check, ends, F.when(proto == 6, tcp).when(proto == 17, udp).otherwise(icmp), body)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    made = {
        "pkt_no": F.col("event_id") + 1, "src_id": F.lit(0), "dltype": F.lit(ETH), "ts_sec": F.floor(micros / 1_000_000), "ts_nsec": F.pmod(micros, F.lit(1_000_000)) * 1000,
        "in_iface": F.pmod(F.col("user_id"), F.lit(4)), "class": (F.col("value") * 100).cast("long"), "data": data,
    }
    rows = events(spark, sf_dir)
    if even:
        rows = spread(rows, "event_id")
    if checksums:  # made once, however many filters and columns read it
        rows = fixed(rows, **{f"__{k}": v for k, v in made.items()})
        made = {k: F.col(f"__{k}") for k in made}
    return rows.select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in PACKET])

"""Flow tracking: keys, ids, events and statistics by gap sessions over canonical endpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelake.functions.bytesx import be_uint, cut
from wirelake.functions.dissect import fixed
from wirelake.functions.fields import field
from wirelake.operators.order import PLACE, running

TIMEOUT = 60.0
UPDATE = 10.0


def header_key(packets: DataFrame) -> DataFrame:
    """Add family, proto, a and b (endpoint bytes) from the headers of ``dissect.with_headers``; null if not Ethernet."""
    d, ip = F.col("data"), F.col("h_ip")
    ports = F.coalesce(F.col("h_tcp"), F.col("h_udp"))
    echo = F.when(be_uint(d, F.col("h_icmp"), 1).isin(0, 8), cut(d, F.col("h_icmp") + 4, 2))
    sport, dport = F.coalesce(cut(d, ports, 2), echo, F.lit(b"\0\0")), F.coalesce(cut(d, ports + 2, 2), echo, F.lit(b"\0\0"))
    eth = F.col("h_net").isNotNull()
    is_ip = ip.isNotNull()
    return fixed(packets, **{
        "family": F.col("h_ethtype").cast("long"),
        "proto": F.when(is_ip, F.col("h_ip_proto").cast("long")).otherwise(F.lit(0)),
        "a": F.when(is_ip, F.concat(cut(d, ip + 12, 4), sport)).when(eth, cut(d, 6, 6)),
        "b": F.when(is_ip, F.concat(cut(d, ip + 16, 4), dport)).when(eth, cut(d, 0, 6)),
    })


def pdu_key(packets: DataFrame) -> DataFrame:
    """As header_key from ``pdus``: IPv4, IPv6 and ARP right after Ethernet, else addresses of the frame."""
    packets = fixed(packets, __second=F.get(F.col("pdus"), F.lit(2)), __third=F.get(F.col("pdus"), F.lit(3)), __family=F.conv(F.hex(field("eth.ethtype")), 16, 10).cast("long"))
    second, third = F.col("__second"), F.col("__third")
    name, inner = second["proto"], third["proto"]
    d = F.col("data")
    ports = F.when(inner.isin("tcp", "udp"), third["soff"])
    query = F.when(inner == "icmp", third["xoffs"]["query"]).when(inner == "icmp6", third["xoffs"]["echo"])
    sport = F.coalesce(cut(d, ports, 2), cut(d, query, 2), F.lit(b"\0\0"))
    dport = F.coalesce(cut(d, ports + 2, 2), cut(d, query, 2), F.lit(b"\0\0"))
    at = second["soff"]
    is_eth = F.get(F.col("pdus"), F.lit(1))["proto"] == "eth"
    arp = second["xoffs"]["etharp"]
    net6 = F.conv(F.hex(cut(d, second["xoffs"]["nxthdr"], 1)), 16, 10).cast("long")

    def ends(ip4: int, ip6: int, arp_at: int, mac: int, port: Column) -> Column:
        return (
            F.when(name == "ip", F.concat(cut(d, at + ip4, 4), port)).when(name == "ip6", F.concat(cut(d, at + ip6, 16), port))
            .when(arp.isNotNull(), cut(d, arp + arp_at, 4)).when(is_eth, cut(d, mac, 6))
        )

    return fixed(packets, **{
        "family": F.col("__family"),
        "proto": F.when(name == "ip", be_uint(d, at + 9, 1)).when(name == "ip6", net6).otherwise(F.lit(0)),
        "a": ends(12, 8, 14, 6, sport), "b": ends(16, 24, 24, 0, dport),
    }).drop("__second", "__third", "__family")


def track(keyed: DataFrame, timeout: float = TIMEOUT) -> DataFrame:
    """Add flow_id and c2s. Packets of one pair of endpoints belong to one flow until a gap of timeout seconds.

    Ids count flows from 1 by their first packet in (src_id, pkt_no) order; the client sent it. Packets
    without a key keep a null id.
    """
    tracked = keyed.where("a is not null")
    key = ["family", "proto", "lo", "hi"]
    w = Window.partitionBy(*key).orderBy(*PLACE)
    t = F.col("ts_sec") * 1_000_000_000 + F.coalesce("ts_nsec", F.lit(0))
    gap = int(timeout * 1_000_000_000)
    rows = tracked.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b"), "__t": t})
    rows = rows.withColumn("__was", F.lag("__t").over(w)).withColumn("__new", F.when(F.col("__was").isNull() | (F.col("__t") - F.col("__was") >= gap), 1).otherwise(0))
    rows = rows.withColumn("__first", F.last(F.when(F.col("__new") == 1, F.struct("src_id", "pkt_no", "a")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("c2s", F.col("a") == F.col("__first.a"))
    firsts = rows.where("__new = 1").select(F.col("src_id").alias("__src"), F.col("pkt_no").alias("__no"))
    ids = running(firsts, F.lit(1), "__id", order=("__src", "__no")).select("__src", "__no", F.col("__id").cast("long").alias("__id"))
    out = rows.join(ids, (F.col("__first.src_id") == F.col("__src")) & (F.col("__first.pkt_no") == F.col("__no"))).withColumn("flow_id", F.col("__id"))
    out = out.drop("lo", "hi", "__t", "__was", "__new", "__first", "__src", "__no", "__id")
    none = keyed.where("a is null").withColumn("c2s", F.lit(None).cast("boolean"))
    return out.unionByName(none if "flow_id" in keyed.columns else none.withColumn("flow_id", F.lit(None).cast("long")))


def stats(tracked: DataFrame, timeout: float = TIMEOUT) -> DataFrame:
    """A row per flow: endpoints, times, and packets and bytes each way."""
    t = F.col("ts_sec") + F.coalesce("ts_nsec", F.lit(0)) / 1e9
    size = F.length("data")
    rows, first = tracked.where("flow_id is not null"), F.struct(*PLACE)
    return rows.groupBy("flow_id").agg(
        F.min_by("family", first).alias("family"), F.min_by("proto", first).alias("proto"), F.min_by("a", first).alias("client"), F.min_by("b", first).alias("server"),
        F.min(t).alias("start"), F.max(t).alias("last"), (F.max(t) + F.lit(timeout)).alias("end"),
        F.count(F.when(F.col("c2s"), 1)).alias("c2s_pkts"), F.coalesce(F.sum(F.when(F.col("c2s"), size)), F.lit(0)).alias("c2s_bytes"),
        F.count(F.when(~F.col("c2s"), 1)).alias("s2c_pkts"), F.coalesce(F.sum(F.when(~F.col("c2s"), size)), F.lit(0)).alias("s2c_bytes"),
    )


def events(tracked: DataFrame, timeout: float = TIMEOUT, update: float = UPDATE) -> DataFrame:
    """START, UPDATE (every update seconds while a flow lasts) and END rows with the time of each."""
    flows = stats(tracked, timeout)
    n = F.floor((F.col("last") - F.col("start")) / F.lit(update)).cast("int")
    ticks = F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(F.lit("UPDATE").alias("event"), (F.col("start") + k * F.lit(update)).alias("at")))).otherwise(F.array().cast("array<struct<event:string,at:double>>"))
    ends = [F.struct(F.lit(name).alias("event"), F.col(at).alias("at")) for name, at in (("START", "start"), ("END", "end"))]
    return flows.select("*", F.explode(F.concat(F.array(ends[0]), ticks, F.array(ends[1]))).alias("e")).select("e.event", "e.at", *flows.columns)


def report(flow_events: DataFrame) -> DataFrame:
    """Event rows as text lines."""
    both = F.format_string("|C2S:%d,%d|S2C:%d,%d|", "c2s_pkts", "c2s_bytes", "s2c_pkts", "s2c_bytes")
    one = F.format_string("|SENT:%d,%d|", "c2s_pkts", "c2s_bytes")
    return flow_events.select(F.concat(F.format_string("|FLOW %s|%d|%s|%s|%.6f", "event", "flow_id", F.hex("client"), F.hex("server"), "at"), F.when(F.col("s2c_pkts") > 0, both).otherwise(one)).alias("line"))

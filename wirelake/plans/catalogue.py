"""Registered queries over packets made from ``events``, and the SQL they are held against.

The SQL reads only columns of ``events``; that the packets' bytes lead to the same rows is what is
tested.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelake import synth_fields
from wirelake.functions import bytesx as B
from wirelake.functions.dissect import header_uint, with_headers, with_pdus
from wirelake.functions.fields import field, implicit, number, present
from wirelake.operators import diff as diffs
from wirelake.operators import edit, flows, fragments, order, sequence, streams
from wirelake.plans import pml
from wirelake.sources import formats, readers
from wirelake.synth import packets

QUERIES = {}
ORACLES = {}
DAYS2 = 172800.0

#: What the SQL needs to know of each event's packet.
PKT = """p AS (SELECT event_id + 1 AS pkt_no, event_id, user_id, event_type, props, value, ts, event_id % 2 AS back,
  CASE event_type WHEN 'click' THEN 80 WHEN 'view' THEN 443 WHEN 'purchase' THEN 8080 WHEN 'signup' THEN 53 END AS port,
  CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS code,
  CASE event_type WHEN 'signup' THEN 17 WHEN 'error' THEN 1 ELSE 6 END AS proto, 1024 + user_id % 60000 AS cport,
  34 + CASE WHEN event_type IN ('signup', 'error') THEN 8 ELSE 20 END + strlen(props) AS len,
  epoch_us(ts) AS us FROM events)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH {PKT} {sql}"
        return f

    return add


def heads(spark, sf) -> DataFrame:
    return with_headers(packets(spark, sf))


def dealt(spark, sf, checksums=False) -> DataFrame:
    """Packets for Python, dealt over all tasks."""
    return packets(spark, sf, checksums, even=True)


def whole(spark, sf, checksums=False) -> DataFrame:
    return with_pdus(dealt(spark, sf, checksums))


SPORT = "CASE WHEN port IS NULL THEN NULL WHEN back = 0 THEN cport ELSE port END"
DPORT = "CASE WHEN port IS NULL THEN NULL WHEN back = 0 THEN port ELSE cport END"


def flagship(spark, sf) -> DataFrame:
    rows = order.keep(heads(spark, sf), (header_uint("tcp", 2, 2) == 80) | (header_uint("tcp", 0, 2) == 80))
    return order.count(rows, F.col("h_ip_proto").alias("proto"), header_uint("tcp", 2, 2).alias("dport"))


@query(f"SELECT proto, {DPORT} AS dport, count(*) AS packets, sum(len)::BIGINT AS bytes FROM p WHERE event_type = 'click' GROUP BY ALL")
def count_tcp_port_80(spark, sf):
    return flagship(spark, sf)


@query("SELECT pkt_no, len FROM p WHERE event_type = 'click' AND back = 0")
def filter_tcp_port(spark, sf):
    return order.keep(heads(spark, sf), header_uint("tcp", 2, 2) == 80).select("pkt_no", F.length("data").cast("long").alias("len"))


@query("SELECT pkt_no FROM p WHERE back = 0 AND user_id < 64")
def filter_cidr_mask(spark, sf):
    src = B.cut(F.col("data"), F.col("h_ip") + 12, 4)
    return order.keep(heads(spark, sf), B.cidr_eq(src, "10.0.0.0/26")).select("pkt_no")


@query("SELECT pkt_no FROM p WHERE regexp_matches(props, '1.*7')")
def filter_regex(spark, sf):
    body = F.coalesce(F.col("h_tcp") + 20, F.col("h_udp") + 8, F.col("h_icmp") + 8)
    return order.keep(heads(spark, sf), B.regex_match(F.expr("substring(data, 1 + coalesce(h_tcp + 20, h_udp + 8, h_icmp + 8))"), "1.*7") & body.isNotNull()).select("pkt_no")


@query("SELECT pkt_no, xor(event_id & 65535, 4660) AS x, (((event_id & 65535) << 17) & 4294967295) AS l, ((event_id & 65535) >> 3) AS r, bit_count(event_id & 65535)::BIGINT AS ones FROM p WHERE (event_id & 5) = 5")
def filter_bitops(spark, sf):
    ident = header_uint("ip", 4, 2)
    rows = order.keep(heads(spark, sf), ident.bitwiseAND(5) == 5)
    return rows.select("pkt_no", ident.bitwiseXOR(0x1234).alias("x"), B.u32(F.shiftleft(ident, 17)).alias("l"), F.shiftright(ident, 3).alias("r"), B.pop_count(ident).alias("ones"))


@query("SELECT pkt_no, (event_id * 65536 + 2147483648) & 4294967295 AS u FROM p WHERE event_id % 32768 < 16384 AND proto = 6")
def filter_signed_compare(spark, sf):
    u = B.u32(header_uint("tcp", 4, 4) * 65536 + (1 << 31))
    return order.keep(heads(spark, sf), (B.s32(B.u32(header_uint("ip", 4, 2) * 131072)) >= 0) & F.col("h_tcp").isNotNull()).select("pkt_no", u.alias("u"))


@query("SELECT pkt_no, CASE WHEN proto = 6 THEN 3 ELSE 0 END::BIGINT AS tcp, CASE WHEN proto = 17 THEN 3 ELSE 0 END::BIGINT AS udp, CASE WHEN proto = 6 THEN port = 443 AND back = 0 ELSE false END AS guarded FROM p")
def missing_field_guard(spark, sf):
    guard = F.when(present("tcp") > 0, number("tcp.dport") == 443).otherwise(False)
    return whole(spark, sf).select("pkt_no", present("tcp").alias("tcp"), present("udp").alias("udp"), guard.alias("guarded"))


@query(f"SELECT pkt_no, proto::BIGINT AS ip_proto, 64::BIGINT AS ttl, {SPORT} AS sport, {DPORT} AS dport, CASE WHEN proto = 6 THEN event_id END AS seqn, CASE WHEN proto = 1 THEN user_id & 65535 END AS icmp_id FROM p")
def dissect_fields(spark, sf):
    sport = F.coalesce(number("tcp.sport"), number("udp.sport"))
    dport = F.coalesce(number("tcp.dport"), number("udp.dport"))
    return whole(spark, sf).select("pkt_no", number("ip.proto").alias("ip_proto"), number("ip.ttl").alias("ttl"), sport.alias("sport"), dport.alias("dport"), number("tcp.seqn").alias("seqn"), number("icmp.id").alias("icmp_id"))


@query("SELECT pkt_no, 20::BIGINT AS hlen, len - 34 AS plen, 0::BIGINT AS tlen, len - 14 AS totlen, 256::BIGINT AS prid, 2::BIGINT AS idx, props AS payload, CASE WHEN proto = 6 THEN 20 ELSE 4294967295 END AS tcp_hlen FROM p")
def implicit_members(spark, sf):
    names = [implicit("ip", m).alias(m) for m in ("hlen", "plen", "tlen", "totlen", "prid")]
    body = F.decode(F.coalesce(field("tcp.payload"), field("udp.payload"), field("icmp.payload")), "UTF-8")
    return whole(spark, sf).select("pkt_no", *names, implicit("ip", "index").alias("idx"), body.alias("payload"), implicit("tcp", "hlen").alias("tcp_hlen"))


@query("SELECT pkt_no, 4::BIGINT AS vers, 5::BIGINT AS ihl, 0::BIGINT AS df, 0::BIGINT AS fragoff, CASE WHEN proto = 6 THEN 5 END::BIGINT AS doff, CASE WHEN proto = 6 THEN 1 END::BIGINT AS psh, CASE WHEN proto = 6 THEN 0 END::BIGINT AS syn FROM p")
def bit_fields(spark, sf):
    names = ("ip.vers", "ip.ihl", "ip.df", "ip.fragoff", "tcp.doff", "tcp.psh", "tcp.syn")
    rows = with_pdus(dealt(spark, sf))
    return rows.select("pkt_no", *[field(n).cast("long").alias(n.split(".")[1]) for n in names])


@query("SELECT proto::BIGINT AS proto, count(*) AS packets, sum(len)::BIGINT AS bytes FROM p GROUP BY 1")
def count_bytes_by_proto(spark, sf):
    return order.count(heads(spark, sf), F.col("h_ip_proto").cast("long").alias("proto"))


@query("SELECT pkt_no FROM p ORDER BY pkt_no LIMIT 10")
def head(spark, sf):
    return order.head(packets(spark, sf)).select("pkt_no")


@query("SELECT pkt_no FROM p ORDER BY pkt_no DESC LIMIT 10")
def tail(spark, sf):
    return order.tail(packets(spark, sf)).select("pkt_no")


@query("SELECT pkt_no, row_number() OVER (ORDER BY pkt_no DESC) AS place FROM p")
def reverse(spark, sf):
    return order.places(order.reverse(packets(spark, sf)).select("pkt_no"))


def two(spark, sf) -> DataFrame:
    """Two streams, each numbered from 1."""
    return packets(spark, sf).withColumn("src_id", F.pmod(F.col("pkt_no"), F.lit(2)).cast("int")).withColumn("pkt_no", F.floor((F.col("pkt_no") + 1) / 2))


@query("SELECT 1 - event_id % 2 AS src, event_id // 2 + 1 AS no, row_number() OVER (ORDER BY 1 - event_id % 2 DESC, event_id DESC) AS place FROM p")
def reverse_two_streams(spark, sf):
    return order.places(order.reverse(two(spark, sf)).select(F.col("src_id").cast("long").alias("src"), F.col("pkt_no").alias("no")))


@query("SELECT 1 - event_id % 2 AS src, event_id // 2 + 1 AS no FROM p ORDER BY 1, 2 LIMIT 7")
def head_two_streams(spark, sf):
    return order.head(two(spark, sf), 7).select(F.col("src_id").cast("long").alias("src"), F.col("pkt_no").alias("no"))


@query("SELECT 1 - event_id % 2 AS src, event_id // 2 + 1 AS no, row_number() OVER (ORDER BY 1 - event_id % 2, event_id)::BIGINT * 10 AS ms FROM p")
def pace_two_streams(spark, sf):
    return order.release_times(two(spark, sf), interval=0.01, delay=0.01).select(F.col("src_id").cast("long").alias("src"), F.col("pkt_no").alias("no"), F.round(F.col("release_at") * 1000).cast("long").alias("ms"))


@query("SELECT pkt_no FROM p WHERE pkt_no BETWEEN 100 AND 250")
def range_number(spark, sf):
    return order.in_range(packets(spark, sf), 100, 250).select("pkt_no")


RANGE = """, m AS (SELECT *, event_type = 'signup' AS s, event_type = 'error' AS e FROM p), q AS (SELECT *, last_value(CASE WHEN e THEN 0 WHEN s THEN 1 END IGNORE NULLS) OVER (ORDER BY pkt_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open FROM m)"""


@query(f"{RANGE} SELECT pkt_no FROM q WHERE s OR open = 1")
def range_expr_multiple(spark, sf):
    udp, icmp = F.col("h_udp").isNotNull(), F.col("h_icmp").isNotNull()
    return order.in_range(heads(spark, sf), udp, icmp, multiple=True).select("pkt_no")


@query(f"{RANGE} SELECT pkt_no FROM q WHERE (s OR open = 1) AND pkt_no <= (SELECT min(pkt_no) FROM q WHERE e AND (s OR open = 1))")
def range_expr_first(spark, sf):
    udp, icmp = F.col("h_udp").isNotNull(), F.col("h_icmp").isNotNull()
    return order.in_range(heads(spark, sf), udp, icmp).select("pkt_no")


@query("SELECT pkt_no FROM p WHERE event_type = 'signup' ORDER BY pkt_no LIMIT 5")
def first_matching(spark, sf):
    return order.first_matching(heads(spark, sf), F.col("h_udp").isNotNull(), 5).select("pkt_no")


def ranked(rows: DataFrame, key, descending=False) -> DataFrame:
    """Places by a key, exported so that order can be compared: distributed, by counts of smaller keys."""
    from pyspark.sql import Window

    by = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", F.substring("k", 1, 2))
    w = Window.partitionBy("bucket").orderBy(F.desc("k") if descending else F.asc("k")).rowsBetween(Window.unboundedPreceding, -1)
    per = by.groupBy("bucket").agg(F.sum("n").alias("m"))
    w2 = Window.orderBy(F.desc("bucket") if descending else F.asc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("bucket", F.coalesce(F.sum("m").over(w2), F.lit(0)).alias("base"))
    base = by.join(per, "bucket").select("k", (F.col("base") + F.coalesce(F.sum("n").over(w), F.lit(0))).alias("base"))
    inside = Window.partitionBy("k").orderBy("pkt_no")
    return rows.join(base, "k").select("pkt_no", (F.col("base") + F.row_number().over(inside)).cast("long").alias("place"))


@query("SELECT pkt_no, row_number() OVER (ORDER BY CASE WHEN back = 0 THEN cport ELSE port END, pkt_no) AS place FROM p WHERE proto = 6")
def sort_key_multi(spark, sf):
    rows = with_pdus(dealt(spark, sf)).where(present("tcp") > 0)
    return ranked(rows.withColumn("k", order.sort_key(["tcp.sport", "ip.ttl"])), "k")


@query("SELECT pkt_no, row_number() OVER (ORDER BY CASE WHEN proto = 6 THEN printf('%08x', event_id) ELSE '' END DESC, pkt_no) AS place FROM p")
def sort_missing_key_reverse(spark, sf):
    rows = with_pdus(dealt(spark, sf))
    return ranked(rows.withColumn("k", order.sort_key(["tcp.seqn"])), "k", descending=True)


@query("SELECT pkt_no, len FROM p ORDER BY len DESC, pkt_no LIMIT 20")
def top_k_by_size(spark, sf):
    return packets(spark, sf).select("pkt_no", F.length("data").cast("long").alias("len")).orderBy(F.desc("len"), "pkt_no").limit(20)


@query("SELECT pkt_no, CASE WHEN proto = 6 THEN 'tcp' WHEN proto = 17 THEN 'udp' ELSE 'none' END AS kind, CASE WHEN proto <> 1 THEN 4 + count(CASE WHEN proto <> 1 THEN 1 END) OVER (ORDER BY pkt_no) END AS seq FROM p")
def seq_embed_extract(spark, sf):
    where = [sequence.Location("tpld", 0, 4), sequence.Location("upld", 0, 4)]
    out = sequence.embed(whole(spark, sf), where, start=5)
    again = sequence.extract(with_pdus(out.drop("pdus")), where)
    kind = F.when(present("tcp") > 0, "tcp").when(present("udp") > 0, "udp").otherwise("none")
    return again.select("pkt_no", kind.alias("kind"), "seq")


@query("SELECT count(*) AS packets, count(*) AS in_order FROM p")
def seq_verify(spark, sf):
    where = [sequence.Location("esrc")]
    out = sequence.extract(with_pdus(sequence.embed(whole(spark, sf), where).drop("pdus")), where)
    return sequence.verify(out).agg(F.count(F.lit(1)).alias("packets"), F.count(F.when(F.col("ok"), 1)).alias("in_order"))


@query(", t AS (SELECT *, min(us) OVER () AS u0 FROM p) SELECT pkt_no, u0 + ((us - u0) // 1000 // 2) * 1000 AS us FROM t")
def scale_time_half(spark, sf):
    out = order.scale_time(packets(spark, sf), 0.5)
    return out.select("pkt_no", (F.col("ts_sec") * 1_000_000 + F.floor(F.col("ts_nsec") / 1000)).alias("us"))


@query("SELECT pkt_no, 250 + (pkt_no - 1) * 10 AS ms FROM p")
def pace_interval(spark, sf):
    return order.release_times(packets(spark, sf), interval=0.01, delay=0.25).select("pkt_no", F.round(F.col("release_at") * 1000).cast("long").alias("ms"))


@query("SELECT pkt_no, (coalesce(sum(len * 8) OVER (ORDER BY pkt_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS us FROM p")
def pace_bits(spark, sf):
    return order.release_times(packets(spark, sf), bps=1e6).select("pkt_no", F.round(F.col("release_at") * 1e6).cast("long").alias("us"))


@query("SELECT pkt_no, us - min(us) OVER () AS us FROM p")
def pace_timestamps(spark, sf):
    return order.release_times(packets(spark, sf)).select("pkt_no", F.round(F.col("release_at") * 1e6).cast("long").alias("us"))


def three(spark, sf) -> DataFrame:
    return packets(spark, sf).withColumn("src_id", F.pmod(F.col("in_iface"), F.lit(3)))


STREAMS = ", s AS (SELECT *, (user_id % 4) % 3 AS src, row_number() OVER (PARTITION BY (user_id % 4) % 3 ORDER BY pkt_no) AS rr FROM p)"


def merged(rows: DataFrame) -> DataFrame:
    """Where each packet comes out of a merge."""
    return order.places(rows.select("pkt_no", F.col("src_id").cast("long").alias("src")))


@query(f"{STREAMS} SELECT pkt_no, src, row_number() OVER (ORDER BY rr, src) AS place FROM s")
def merge_round_robin(spark, sf):
    return merged(streams.merge_round_robin(three(spark, sf)))


@query(f"{STREAMS}, t AS (SELECT *, us - (event_id % 5) * 86400000000 AS moved FROM s), k AS (SELECT *, max(moved) OVER (PARTITION BY src ORDER BY pkt_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM t WHERE event_id % 7 <> 3) SELECT pkt_no, src, row_number() OVER (ORDER BY moved, src, pkt_no) AS place FROM k WHERE m IS NULL OR moved >= m")
def merge_time(spark, sf):
    """Some packets have no timestamp and some go back in time: both kinds are left out."""
    back = F.col("ts_sec") - F.pmod(F.col("pkt_no") - 1, F.lit(5)) * 86400
    rows = three(spark, sf).withColumn("ts_sec", F.when(F.pmod(F.col("pkt_no") - 1, F.lit(7)) != 3, back))
    return merged(streams.merge_time(rows))


@query(f"{STREAMS}, n AS (SELECT *, count(*) OVER (PARTITION BY src) AS n FROM s), c AS (SELECT *, min(n) OVER () AS cost FROM n), r AS (SELECT *, (rr * cost + n - 1) // n AS round FROM c), w AS (SELECT *, row_number() OVER (PARTITION BY src, round ORDER BY pkt_no) AS sweep FROM r) SELECT pkt_no, src, row_number() OVER (ORDER BY round, sweep, src) AS place FROM w")
def merge_proportional(spark, sf):
    return merged(streams.merge_proportional(three(spark, sf)))


@query(f"{STREAMS}, b AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY src ORDER BY pkt_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sent, sum(len) OVER (PARTITION BY src) AS own, sum(len) OVER () AS total FROM s), q AS (SELECT *, greatest(1, floor(own / total::DOUBLE * 1536)::BIGINT) AS share FROM b), r AS (SELECT *, (sent + share - 1) // share AS round FROM q), w AS (SELECT *, row_number() OVER (PARTITION BY src, round ORDER BY pkt_no) AS sweep FROM r) SELECT pkt_no, src, row_number() OVER (ORDER BY round, sweep, src) AS place FROM w")
def merge_by_bytes(spark, sf):
    return merged(streams.merge_by_bytes(three(spark, sf)))


@query(f"{STREAMS} SELECT pkt_no, src, rr FROM s")
def merge_random(spark, sf):
    """Random, but every packet comes out, and each stream keeps its order."""
    from pyspark.sql import Window

    out = merged(streams.merge_random(three(spark, sf)))
    return out.select("pkt_no", "src", F.row_number().over(Window.partitionBy("src").orderBy("place")).cast("long").alias("rr"))


@query("SELECT pkt_no, event_id % 2 AS iface, row_number() OVER (ORDER BY us, event_id % 2, pkt_no) AS place FROM p")
def mux_streams(spark, sf):
    base = packets(spark, sf)
    out = streams.mux(base.where("pkt_no % 2 = 1"), base.where("pkt_no % 2 = 0"))
    return order.places(out.select("pkt_no", F.col("in_iface").cast("long").alias("iface")))


@query("SELECT k AS src, event_id + 1 AS pkt_no FROM p, (VALUES (0), (1)) v(k) WHERE k = 0 OR event_id % 2 = 1")
def concat_streams(spark, sf):
    base = packets(spark, sf)
    return streams.concat(base, base.where("pkt_no % 2 = 0")).select(F.col("src_id").alias("src"), "pkt_no")


@query("SELECT pkt_no, k AS round, k * (SELECT count(*) FROM p) + pkt_no AS place FROM p, range(3) v(k) WHERE k * (SELECT count(*) FROM p) + pkt_no <= 2500")
def merge_repeated(spark, sf):
    """A stream played three times, 2,500 packets at most."""
    return order.places(streams.repeated(packets(spark, sf), 3, 2500).select("pkt_no", F.col("round").cast("long").alias("round")))


@query("SELECT CASE WHEN user_id % 4 < 2 THEN (user_id % 4)::VARCHAR ELSE 'rest' END AS port, count(*) AS packets FROM p WHERE user_id % 4 <> 2 GROUP BY 1")
def demux_counts(spark, sf):
    base = packets(spark, sf).withColumn("out_iface", F.when(F.col("in_iface") < 3, F.col("in_iface")))
    out = None
    for port, s in streams.demux(base, 3, opened={0, 1}).items():
        one = s.agg(F.count(F.lit(1)).alias("packets")).select(F.lit(str(port)).alias("port"), "packets")
        out = one if out is None else out.unionByName(one)
    return out


FLOW = f""", k AS (SELECT *, us * 1000 AS ns, lag(us) OVER w AS was FROM p WINDOW w AS (PARTITION BY proto, user_id, code ORDER BY pkt_no)),
s AS (SELECT *, sum(CASE WHEN was IS NULL OR us - was >= {int(DAYS2) * 1000000} THEN 1 ELSE 0 END) OVER (PARTITION BY proto, user_id, code ORDER BY pkt_no) AS sess FROM k),
f AS (SELECT *, min(pkt_no) OVER v AS fst, first_value(back) OVER (PARTITION BY proto, user_id, code, sess ORDER BY pkt_no) AS fback FROM s WINDOW v AS (PARTITION BY proto, user_id, code, sess)),
g AS (SELECT *, dense_rank() OVER (ORDER BY fst) AS flow_id FROM f)"""


def tracked(spark, sf) -> DataFrame:
    return flows.track(flows.header_key(heads(spark, sf)), DAYS2)


@query(f"{FLOW} SELECT pkt_no, flow_id, back = fback AS c2s FROM g")
def flow_ids(spark, sf):
    return tracked(spark, sf).select("pkt_no", "flow_id", "c2s")


@query(f"{FLOW} SELECT pkt_no, flow_id FROM g")
def flow_ids_from_pdus(spark, sf):
    return flows.track(flows.pdu_key(whole(spark, sf)), DAYS2).select("pkt_no", "flow_id")


@query(f"{FLOW} SELECT flow_id, count(*) FILTER (back = fback) AS c2s_pkts, coalesce(sum(len) FILTER (back = fback), 0)::BIGINT AS c2s_bytes, count(*) FILTER (back <> fback) AS s2c_pkts, coalesce(sum(len) FILTER (back <> fback), 0)::BIGINT AS s2c_bytes FROM g GROUP BY 1")
def flow_stats(spark, sf):
    return flows.stats(tracked(spark, sf), DAYS2).select("flow_id", "c2s_pkts", "c2s_bytes", "s2c_pkts", "s2c_bytes")


@query(f"{FLOW}, d AS (SELECT flow_id, (max(us) - min(us)) // 86400000000 AS n FROM g GROUP BY 1) SELECT event, count(*)::BIGINT AS n FROM (SELECT unnest(list_concat(['START', 'END'], list_transform(range(n), lambda x: 'UPDATE'))) AS event FROM d) GROUP BY 1")
def flow_events(spark, sf):
    return flows.events(tracked(spark, sf), DAYS2, 86400.0).groupBy("event").agg(F.count(F.lit(1)).alias("n"))


@query(f"{FLOW} SELECT flow_id, count(*) AS packets FROM g GROUP BY 1 HAVING count(*) > 2")
def flow_split_counts(spark, sf):
    return tracked(spark, sf).groupBy("flow_id").agg(F.count(F.lit(1)).alias("packets")).where("packets > 2")


@query("SELECT pkt_no, true AS ok, 0::BIGINT AS errors FROM p")
def checksum_fix(spark, sf):
    def change(p, row):
        p.fix_csums()

    out = with_pdus(edit.edit(dealt(spark, sf), change))
    errors = F.aggregate("pdus", F.lit(0).cast("long"), lambda a, u: a + u["error"].cast("long"))
    return out.select("pkt_no", (errors == 0).alias("ok"), errors.alias("errors"))


@query("SELECT pkt_no, true AS ip_ok FROM p")
def checksum_columns(spark, sf):
    rows = with_headers(packets(spark, sf, checksums=True))
    return rows.select("pkt_no", (B.ones_sum(B.cut(F.col("data"), F.col("h_ip"), 20)) == 0xFFFF).alias("ip_ok"))


@query("SELECT pkt_no, 9 AS ttl, len FROM p")
def assign_fields(spark, sf):
    out = with_pdus(edit.assign(whole(spark, sf), "ip.ttl", F.lit(b"\x09")).drop("pdus"))
    return out.select("pkt_no", number("ip.ttl").cast("int").alias("ttl"), F.length("data").cast("long").alias("len"))


@query("SELECT pkt_no, true AS same, len + 24 AS wrapped FROM p")
def encap_decap_gre(spark, sf):
    def there(p, row):
        edit.gre_encap(p, bytes([172, 16, 0, 1]), bytes([172, 16, 0, 2]))

    def back(p, row):
        return edit.gre_decap(p)

    base = dealt(spark, sf)
    out = edit.edit(base, there)
    size = out.select("pkt_no", F.length("data").cast("long").alias("wrapped"), "data", "dltype", *[c for c in base.columns if c not in ("pkt_no", "data", "dltype")])
    again = edit.edit(size, back)
    return again.join(base.select(F.col("pkt_no").alias("n"), F.col("data").alias("d")), F.col("pkt_no") == F.col("n")).select("pkt_no", (F.col("d") == F.col("data")).alias("same"), "wrapped")


@query("SELECT pkt_no, true AS same FROM p")
def encap_decap_vxlan(spark, sf):
    def both(p, row):
        edit.vxlan_encap(p, 42)
        return edit.vxlan_decap(p)

    base = dealt(spark, sf)
    again = edit.edit(base, both)
    return again.join(base.select(F.col("pkt_no").alias("n"), F.col("data").alias("d")), F.col("pkt_no") == F.col("n")).select("pkt_no", (F.col("d") == F.col("data")).alias("same"))


@query("SELECT pkt_no, 100 + pkt_no % 7 AS label, true AS same FROM p")
def mpls_vlan_push_pop(spark, sf):
    def change(p, row):
        was = bytes(p.data)
        p.mpls_push(100 + row["pkt_no"] % 7)
        p.vlan_push(5)
        row["class"] = p.get("mpls.label")
        p.vlan_pop()
        p.mpls_pop()
        row["seq"] = int(bytes(p.data) == was)

    return edit.edit(dealt(spark, sf), change).select("pkt_no", F.col("class").alias("label"), (F.col("seq") == 1).alias("same"))


@query("SELECT pkt_no, ceil((len - 34) / 16)::BIGINT AS fragments FROM p")
def fragment_counts(spark, sf):
    out = fragments.fragment(dealt(spark, sf), mtu=36, df="fragment")
    return out.groupBy("pkt_no").agg(F.count(F.lit(1)).alias("fragments"))


@query("SELECT pkt_no, len, true AS same, (len - 34) % 16 = 0 AS even FROM p WHERE event_id % 65536 > 0")
def fragment_reassemble(spark, sf):
    """Fragments in reverse order, put together again: every byte is as before."""
    base = dealt(spark, sf, checksums=True).where(F.substring("data", 19, 2) != F.lit(b"\0\0"))
    cut = fragments.fragment(base, mtu=36, df="fragment")
    one = cut.withColumn("at", -F.col("sub_no"))
    out = fragments.reassemble(with_pdus(one), order=("pkt_no", "at"))
    was = base.select(F.col("pkt_no").alias("n"), F.sha2("data", 256).alias("was"))
    out = out.join(was, F.col("pkt_no") == F.col("n"))
    return out.select("pkt_no", F.length("data").cast("long").alias("len"), (F.sha2("data", 256) == F.col("was")).alias("same"), ((F.length("data") - 34) % 16 == 0).alias("even"))


@query(", t AS (SELECT *, lag(back) OVER w AS was, first_value(back) OVER w AS fst FROM p WHERE proto = 6 WINDOW w AS (PARTITION BY user_id, code ORDER BY pkt_no)) SELECT user_id, code, 1 + count(*) FILTER (back <> was) AS files, sum(strlen(props)) FILTER (back = fst)::BIGINT AS c2s, coalesce(sum(strlen(props)) FILTER (back <> fst), 0)::BIGINT AS s2c, md5(string_agg(props, '' ORDER BY pkt_no)) AS text FROM t GROUP BY 1, 2")
def carve_streams(spark, sf):
    """Both directions of every connection, its sequence numbers made dense: files, bytes each way, and the text of all files."""
    from pyspark.sql import Window

    tcp = order.keep(heads(spark, sf), F.col("h_tcp").isNotNull())
    ends = F.substring("data", 27, 4)
    w = Window.partitionBy("ends", "other").orderBy("pkt_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = tcp.withColumns({"ends": ends, "other": F.substring("data", 31, 4), "size": F.length("data").cast("long") - 54})
    rows = rows.withColumn("s", F.lit(1) + F.coalesce(F.sum("size").over(w), F.lit(0)))
    dense = rows.withColumn("data", B.splice(F.col("data"), F.col("h_tcp") + 4, B.be_bytes(F.col("s"), 4), 4)).drop("ends", "other", "size", "s")
    out = fragments.carve(with_pdus(dense))
    ways = {k: F.coalesce(F.sum(F.when(F.col("direction") == k.upper(), F.length("bytes"))), F.lit(0)).alias(k) for k in ("c2s", "s2c")}
    text = F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_no", "bytes"))), lambda x: x["bytes"].cast("string")), "").cast("binary"))
    user, code = B.be_uint(F.substring("conn", 1, 4), 0, 4) - (10 << 24), B.be_uint(F.substring("conn", 7, 4), 3, 1).cast("int")
    return out.groupBy(user.alias("user_id"), code.alias("code")).agg(F.count(F.lit(1)).alias("files"), *ways.values(), text.alias("text"))


@query("SELECT 'PASS' AS op, pkt_no AS before_no, pkt_no AS after_no, 0.0::DOUBLE AS cost FROM p")
def diff_self(spark, sf):
    rows = packets(spark, sf)
    return diffs.diff(rows, rows).select("op", "before_no", "after_no", "cost")


@query("SELECT CASE WHEN pkt_no % 10 = 3 THEN 'DROP' WHEN pkt_no % 9 = 7 THEN 'INSERT' ELSE 'PASS' END AS op, CASE WHEN pkt_no % 10 = 3 OR pkt_no % 9 <> 7 THEN pkt_no END AS before_no, CASE WHEN pkt_no % 10 <> 3 THEN pkt_no END AS after_no FROM p WHERE NOT (pkt_no % 10 = 3 AND pkt_no % 9 = 7)")
def diff_insert_drop(spark, sf):
    """More packets come in than go: windows stay in step all the same."""
    rows = packets(spark, sf).where("not (pkt_no % 10 = 3 and pkt_no % 9 = 7)")
    return diffs.diff(rows.where("pkt_no % 9 <> 7"), rows.where("pkt_no % 10 <> 3"), window=45, modify=False).select("op", "before_no", "after_no")


@query("SELECT CASE WHEN event_id % 11 = 4 AND proto = 6 THEN 'MODIFY' ELSE 'PASS' END AS op, pkt_no AS before_no, pkt_no AS after_no, CASE WHEN event_id % 11 = 4 AND proto = 6 THEN round(7.0 / (8 * len) * 3, 9) ELSE 0.0 END::DOUBLE AS cost FROM p")
def diff_modified(spark, sf):
    """Three bits of some packets change: their places stay, at the price of three bits."""
    rows = packets(spark, sf)
    changed = B.splice(F.col("data"), 22, F.lit(b"\x47"), 1)
    after = rows.withColumn("data", F.when((F.pmod(F.col("pkt_no") - 1, F.lit(11)) == 4) & (F.substring("data", 24, 1) == F.lit(b"\x06")), changed).otherwise(F.col("data")))
    return diffs.diff(rows, after).select("op", "before_no", "after_no", F.round("cost", 9).alias("cost"))


@query("SELECT pkt_no, CASE WHEN back = 0 THEN '10.0.' || (user_id // 256) || '.' || (user_id % 256) ELSE '192.168.0.' || code END AS ip, CASE WHEN back = 0 THEN '02:00:00:00:' || printf('%02x', user_id // 256) || ':' || printf('%02x', user_id % 256) ELSE '02:01:00:00:00:' || printf('%02x', code) END AS eth, upper(printf('%04x', event_id % 65536)) AS hex FROM p")
def fmt_ip_eth_hex(spark, sf):
    d = F.col("data")
    rows = heads(spark, sf)
    return rows.select("pkt_no", B.fmt_ip(B.cut(d, F.col("h_ip") + 12, 4)).alias("ip"), B.fmt_eth(B.cut(d, 6, 6)).alias("eth"), F.hex(B.cut(d, F.col("h_ip") + 4, 2)).alias("hex"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS packets, sum(len)::BIGINT AS bytes FROM p GROUP BY 1")
def window_tumbling(spark, sf):
    rows = packets(spark, sf).withColumn("at", F.timestamp_seconds("ts_sec"))
    out = rows.groupBy(F.window("at", "1 day")).agg(F.count(F.lit(1)).alias("packets"), F.sum(F.length("data")).alias("bytes"))
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "packets", "bytes")


@query("SELECT user_id % 4 AS iface, count(*) AS packets, sum(floor(value * 100))::BIGINT AS class, sum(us // 1000000)::BIGINT AS seconds, sum(us % 1000000)::BIGINT AS micros FROM p GROUP BY 1")
def meta_tags(spark, sf):
    rows = packets(spark, sf).groupBy(F.col("in_iface").cast("long").alias("iface"))
    return rows.agg(F.count(F.lit(1)).alias("packets"), F.sum("class").alias("class"), F.sum("ts_sec").alias("seconds"), F.sum((F.col("ts_nsec") / 1000).cast("long")).alias("micros"))


@query("SELECT pkt_no FROM p WHERE proto = 6 AND port IN (80, 8080) AND back = 0 AND user_id < 128")
def pml_filter(spark, sf):
    library = "inline web(int p) { tcp and (tcp.dport == p or tcp.dport == p * 101) }"
    test = pml.predicate("web(80) and ip.saddr =~ 10.0.0.0/25", library)
    return order.keep(whole(spark, sf), test).select("pkt_no")


@query("SELECT pkt_no FROM p WHERE proto = 17 AND regexp_matches(props, 'k.*5') AND (event_id & 65535) % 3 = 1")
def pml_filter_regex_arithmetic(spark, sf):
    return order.keep(whole(spark, sf), pml.predicate("udp and udp.payload =~ `k.*5` and ip.id % 3 == 1")).select("pkt_no")


@query("SELECT user_id % 4 AS iface, count(*) FILTER (proto = 6) AS sent, 7 AS ttl FROM p GROUP BY 1 HAVING count(*) FILTER (proto = 6) > 0")
def pml_program_by_key(spark, sf):
    text = "int n; ?- tcp -? { n = n + 1; ip.ttl = 7; send; } ?- not (tcp) -? { drop; }"
    out = pml.run(dealt(spark, sf), text, key="in_iface").where("printed is null")
    rows = with_pdus(out.drop("sub_no", "printed"))
    return rows.groupBy(F.col("in_iface").cast("long").alias("iface")).agg(F.count(F.lit(1)).alias("sent"), F.max(number("ip.ttl")).cast("int").alias("ttl"))


@query("SELECT (user_id % 4)::INTEGER AS iface, 'n=' || count(*) AS printed FROM p GROUP BY 1")
def pml_begin_end_print(spark, sf):
    text = "int n; int i; { n = n + 1; i = meta_get_inport(0); drop; } END { print \"n=\", n, ; print \" i=\", i; }"
    out = pml.run(packets(spark, sf), text, key="in_iface").where("printed is not null")
    return out.select(F.regexp_extract("printed", "i=([0-9]+)", 1).cast("int").alias("iface"), F.regexp_extract("printed", "^(n=[0-9]+)", 1).alias("printed"))


def printed_by(name: str, text: str, sql: str) -> None:
    """A query of what a program prints, a stream for each interface."""

    def run(spark, sf):
        return pml.run(dealt(spark, sf), text, key="in_iface").where("printed is not null").select("printed")

    run.__name__ = name
    query(sql)(run)


ID = "(event_id % 65536)"
printed_by(
    "pml_strings",
    "?- tcp -? { str r; &r = tcp.payload; print meta_get_ts_sec(0), \" \", str_len(r), \" \", str_addr(r), \" \", str_ispkt(r), str_seg(r), str_isnull(r), \" \", str_len(str_mkref(1, 0, 0, 14)), \" \", r[2, 1]; }",
    "SELECT (us // 1000000) || ' ' || strlen(props) || ' 54 100 14 k' AS printed FROM p WHERE proto = 6",
)
printed_by(
    "pml_references",
    'void put(str s, int v) { s[0, 1] = v; } str buf[4] = "abcd"; { str r; &r = ip.ttl; r[0, 1] = ip.id % 200; put(ip.proto, 253); &r = buf[1, 2]; r = "XY"; print ip.ttl + 0, " ", ip.proto + 0, " ", buf, " ", ip.id + 0; buf = "abcd"; }',
    f"SELECT ({ID} % 200) || ' 253 aXYd ' || {ID} AS printed FROM p",
)
printed_by(
    "pml_packet_edits",
    "?- udp -? { pkt_copy(1, 0); pdu_delete($(1)udp); print ip.id + 0, \" \", str_len($(1)pkt), \" \", $(1)udp.index, $(1)ip.index, \" \", $(1)ip.len + 0;"
    " pdu_insert($(1)ip, @udp); $(1)udp.dport = 99; fix_len($(1)udp); fix_lens(1); fix_csum($(1)ip); fix_csums(1); pkt_parse(1); print str_len($(1)pkt), \" \", $(1)udp.index, \" \", $(1)udp.dport + 0, \" \", $(1)ip.error, \" \", $(1)udp.len + 0;"
    " pkt_ins_u(1, 42, 4); pkt_ins_d(1, 42, 2); pkt_cut_d(str_mkref(1, 1, 0, 2)); pkt_cut_u(str_mkref(1, 1, 0, 1)); print str_len($(1)pkt); pkt_new(2, 5); pkt_new_z(3, 9); pkt_swap(2, 3); print str_len($(2)pkt), str_len($(3)pkt); pdu_delete(eth); fix_dltype(0); pdu_update(ip); print eth.index, ip.index; drop 1; drop 2; drop 3; }",
    f"SELECT unnest([{ID} || ' ' || (len - 8) || ' 02 ' || (len - 22), len || ' 3 99 0 ' || (8 + strlen(props)), (len + 3)::VARCHAR, '05', '01']) AS printed FROM p WHERE proto = 17",
)
printed_by(
    "pml_offsets",
    "?- tcp -? { pkt_adj_off(0, @tcp, 0, 1, 4); print ip.id + 0, \" \", pkt_get_off(0, @ip, 0, 0), \" \", pkt_get_off(0, @tcp, 0, 1), \" \", pkt_get_off(0, @eth, 0, 4), \" \", tcp.hlen; }",
    f"SELECT {ID} || ' 14 58 12 24' AS printed FROM p WHERE proto = 6",
)
printed_by(
    "pml_tags",
    "{ meta_set_ts(0, 5, 6); meta_set_presnap(0, 70); meta_set_outport(0, 3); meta_set_flowid(0, 77); meta_set_seq(0, ip.id); print ip.id + 0, \" \", meta_get_ts_sec(0), meta_get_ts_nsec(0), \" \", meta_get_presnap(0), \" \", meta_get_inport(0), meta_get_outport(0), \" \", meta_get_flowid(0), \" \", meta_get_seq(0);"
    " meta_set_class(0, 41); meta_wr8(0, 6, 11, 42); meta_rem(0, 5); meta_add(0, 5); meta_wr32(0, 5, 8, ip.id); meta_wr16(0, 5, 4, 1); meta_set_inport(0, 9); meta_add_info(0, 2); meta_wr32(0, 128, 4, 7);"
    " print meta_get_class(0), \" \", meta_has(0, 2), meta_has(0, 8), meta_has(0, 128), \" \", meta_rd32(0, 5, 8), \" \", meta_rd16(0, 5, 4), meta_rd8(0, 128, 7), \" \", meta_get_inport(0); }",
    f"SELECT unnest([{ID} || ' 56 70 ' || user_id % 4 || '3 77 ' || {ID}, '42 101 ' || {ID} || ' 17 9']) AS printed FROM p",
)
printed_by(
    "pml_loops",
    "const TEN = 10; int digits(int n) { int s; while (1) { if (n == 0) break; s = s + n % TEN; n = n / TEN; } return s; } int gcd(int a, int b) { if (b == 0) return a; else return gcd(b, a % b); } inline odd(int n) { n % 2 == 1 }"
    " int odds; { int k; int c; while (k < 9) { k = k + 1; if (odd(k)) continue; c = c + 1; } print digits(ip.id), \" \", gcd(ip.id, 36), \" \", c; }",
    f"SELECT list_sum(list_transform(string_split({ID}::VARCHAR, ''), lambda x: x::INTEGER))::BIGINT || ' ' || gcd({ID}, 36) || ' 4' AS printed FROM p",
)
printed_by(
    "pml_arithmetic",
    "{ print pop(ip.id), \" \", log2(ip.id), \" \", min(ip.id, 300), \" \", max(-5, ip.id - 300), \" \", ~ip.id & 0xff, \" \", -ip.id, \" \", not ip.id, \" \", ip.id > 100 and ip.id < 200, \" \", ip.id | 3, \" \", ip.id ^ 5, \" \", (ip.id << 20) >> 24; }",
    f"SELECT bit_count({ID}) || ' ' || CASE WHEN {ID} = 0 THEN -1 ELSE strlen(bin({ID})) - 1 END || ' ' || least({ID}, 300) || ' ' || greatest(-5, {ID} - 300) || ' ' || (255 - {ID} % 256) || ' ' || -{ID} || ' ' || ({ID} = 0)::INTEGER || ' ' || ({ID} BETWEEN 101 AND 199)::INTEGER || ' ' || ({ID} | 3) || ' ' || xor({ID}, 5) || ' ' || ({ID} % 4096) // 16 AS printed FROM p",
)
printed_by(
    "pml_formats",
    "{ print %x% ip.id, \" \", %o% ip.id, \" \", %b% ip.id, \" \", %u% -1, \" \", %+6d% ip.id, \"|\", %-6d% ip.id, \"|\", %ip% ip.saddr, \" \", %eth% eth.src, \" \", %hex% ip.id, %s% \" z\"; }",
    f"SELECT printf('%x', {ID}) || ' ' || printf('%o', {ID}) || ' ' || bin({ID}) || ' 4294967295 ' || lpad({ID}::VARCHAR, 6, ' ') || '|' || rpad({ID}::VARCHAR, 6, ' ') || '|' || CASE WHEN back = 0 THEN '10.0.' || (user_id // 256) || '.' || (user_id % 256) ELSE '192.168.0.' || code END || ' ' || CASE WHEN back = 0 THEN '02:00:00:00:' || printf('%02x', user_id // 256) || ':' || printf('%02x', user_id % 256) ELSE '02:01:00:00:00:' || printf('%02x', code) END || ' ' || printf('%04x', {ID}) || ' z' AS printed FROM p",
)
printed_by(
    "std_tests",
    'import "std"; { print ip.id + 0, " ", host(10.0.0.5), host(192.168.0.0), host(02:01:00:00:00:03), host_pn(0, ::1), " ", etype_is_vlan(ETYPE_S_VLAN), vlan_present(), pkt_headroom(), pkt_tailroom_pn(0), pkt_headroom_pn(0), pkt_tailroom(), flowid(), " ", VXLAN_PORT, MAC_TYPE_ANY, MAC_TYPE_UNICAST; }',
    f"SELECT {ID} || ' ' || (user_id = 5)::INTEGER || (code = 0)::INTEGER || (code = 3)::INTEGER || '0 100000-1 478901' AS printed FROM p",
)
printed_by(
    "std_vlan",
    "{ vlan_push(ip.id % 4096); print ip.id + 0, \" \", eth.vlan0.vid, \" \", vlan_present(), vlan_present_pn(0), \" \", str_len(pkt); vlan_push_pn(0, 7); print eth.vlan0.vid, \" \", eth.vlan1.vid; vlan_pop(); vlan_pop_pn(0); print vlan_present(), \" \", str_len(pkt); }",
    f"SELECT unnest([{ID} || ' ' || {ID} % 4096 || ' 11 ' || (len + 4), '7 ' || {ID} % 4096, '0 ' || len]) AS printed FROM p",
)
printed_by(
    "std_mpls",
    "{ pdu_pop(); mpls_push(ip.id, 5, 9); mpls_push_pn(0, 2000, 1, 8); print ip.id + 0, \" \", mpls_nlabels(), mpls_nlabels_pn(0), \" \", mpls_get_label(0), \" \", mpls_get_label_pn(0, 1), \" \", mpls_get_tc(0), mpls_get_tc_pn(0, 1), mpls_get_bos(0), mpls_get_bos_pn(0, 1), mpls_get_ttl(0), mpls_get_ttl_pn(0, 1);"
    " mpls_set_label(0, 77); mpls_set_tc(0, 2); mpls_set_ttl(0, 3); mpls_set_label_pn(0, 1, 78); mpls_set_tc_pn(0, 1, 3); mpls_set_ttl_pn(0, 1, 4); mpls_set_bos(0, 1); mpls_set_bos_pn(0, 0, 0); print mpls_get_label(0), mpls_get_tc(0), mpls_get_ttl(0), mpls_get_label(1), mpls_get_tc(1), mpls_get_ttl(1), mpls_get_bos(0); print mpls_pop() >> 12, \" \", mpls_pop_pn(0) >> 12, \" \", mpls_pop(), \" \", ip.index; }",
    f"SELECT unnest([{ID} || ' 22 2000 ' || {ID} || ' 150189', '77237834' || '0', '77 78 0 1']) AS printed FROM p",
)
printed_by(
    "std_tunnels",
    "{ gre_encap(); print gre.index, $(0, 1)eth.index; gre_decap(); nvgre_encap(); print nvgre.index; nvgre_decap(); vxlan_encap(); udp.dport = VXLAN_PORT; print vxlan.index, \" \", str_len(pkt); vxlan_decap(); print ip.id + 0, \" \", eth.index, ip.index, \" \", str_len(pkt);"
    " pdu_pop_pn(0); eth_wrap(); print eth.index, \" \", str_len(pkt); ip_wrap(); ip6_wrap(); icmp_wrap(); icmp6_wrap(); tcp_wrap(); udp_wrap(); gre_wrap(); nvgre_wrap(); vxlan_wrap(); print vxlan.index, nvgre.index, gre.index, udp.index, tcp.index, icmp6.index, icmp.index, ip6.index, ip.index, \" \", str_len(pkt); }",
    f"SELECT unnest(['34', '3', '4 ' || (len + 50), {ID} || ' 12 ' || len, '1 ' || len, '123456789 ' || (len + 124)]) AS printed FROM p",
)
printed_by(
    "std_packets",
    "{ mk_udp_pn(1); mk_tcp_pn(2); mk_arp_pn(3); fix_pn(1); print ip.id + 0, \" \", $(1)udp.index, $(2)tcp.index, $(3)arp.index, \" \", $(1)ip.error, $(2)tcp.error, \" \", str_len($(1)pkt), \" \", str_len($(2)pkt), \" \", str_len($(3)pkt); drop 1; drop 2; drop 3; fix(); print ip.error;"
    " print pkt_splice(ip.daddr, \"abcdef\"), pkt_splice(\"no\", \"x\"), \" \", str_len(pkt); mk_tcp(); print tcp.index; mk_udp(); print udp.index; mk_arp(); print arp.index; drop 0; }",
    f"SELECT unnest([{ID} || ' 332 00 1834 1846 42', '0', '0-1 ' || (len + 2), '3', '3', '2']) AS printed FROM p",
)
printed_by(
    "std_random",
    '{ rand_init("Key"); print ip.id + 0, " ", %x% rand_byte(), " ", %x% rand_short(), " ", %x% rand_int(), " ", rand_i; rand_mac(eth.src, MAC_TYPE_MULTICAST); print %eth% eth.src; rand_init("Wiki"); rand_mac(eth.dst, MAC_TYPE_LOC_UNICAST); print %eth% eth.dst; }',
    f"SELECT unnest([{ID} || ' eb 9f77 81b734ca 7', '73:a7:19:4a:28:67', '62:44:db:6d:41:b7']) AS printed FROM p",
)


@query("SELECT pkt_no FROM p WHERE user_id = 7 OR (code = 2 AND user_id % 2 = 1)")
def std_host_filter(spark, sf):
    test = pml.predicate("host(10.0.0.7) or (host(192.168.0.2) and (eth.src[5, 1] & 1 == 1 and ip.saddr[0, 1] == 10 or eth.dst[5, 1] & 1 == 1 and ip.daddr[0, 1] == 10))")
    return order.keep(whole(spark, sf), test).select("pkt_no")


@query("SELECT pkt_no, CASE WHEN event_id % 4 = 0 THEN 'any' WHEN event_id % 4 = 1 THEN 'broadcast' WHEN event_id % 4 = 2 THEN 'localhost' ELSE 'localnet' END AS kind FROM p")
def address_constants(spark, sf):
    made = F.when(F.col("pkt_no") % 4 == 1, F.lit(bytes(4))).when(F.col("pkt_no") % 4 == 2, F.lit(bytes([255] * 4))).when(F.col("pkt_no") % 4 == 3, F.lit(bytes([127, 0, 0, 1]))).otherwise(F.lit(bytes([127, 9, 8, 7])))
    rows = with_pdus(dealt(spark, sf).withColumn("data", B.splice(F.col("data"), 30, made, 4)))
    kind = F.lit(None)
    for name in ("localnet", "localhost", "any", "broadcast"):
        op = "=~" if name == "localnet" else "=="
        kind = F.when(pml.predicate(f"ip.daddr {op} ip.addr.{name}"), name).otherwise(kind)
    return rows.select("pkt_no", kind.alias("kind"))


@query(", n AS (SELECT *, row_number() OVER (PARTITION BY user_id % 4 ORDER BY pkt_no) AS rn, count(*) OVER (PARTITION BY user_id % 4) AS total FROM p) SELECT pkt_no, CASE WHEN rn % 2 = 0 THEN rn - 1 WHEN rn = total THEN rn ELSE rn + 1 END AS place FROM n")
def pml_lists(spark, sf):
    from pyspark.sql import Window

    text = "int n; { n = n + 1; if (n % 2 == 1) { pkt_push(3, 0); pkt_pop(3, 5); pkt_enq(pkt_nlists() - 1, 5); } else { pkt_deq(255, 1); send 0; send 1; } } END { if (not pkt_lempty(255)) { pkt_deq(255, 0); send 0; } }"
    out = pml.run(packets(spark, sf), text, key="in_iface").where("printed is null")
    return out.select("pkt_no", F.row_number().over(Window.partitionBy("in_iface").orderBy("sub_no")).cast("long").alias("place"))


@query(", n AS (SELECT *, row_number() OVER (PARTITION BY user_id % 4 ORDER BY pkt_no) AS rn FROM p) SELECT pkt_no FROM n WHERE rn <= 5")
def pml_exit(spark, sf):
    return pml.run(packets(spark, sf), "int n; { n = n + 1; if (n > 5) { drop 0; exit(0); } }", key="in_iface").where("printed is null").select("pkt_no")


@query(", n AS (SELECT user_id % 4 AS iface, us // 1000000 AS s, ROW_NUMBER() OVER (PARTITION BY user_id % 4 ORDER BY pkt_no) AS rn, count(*) OVER (PARTITION BY user_id % 4) AS total, min(us) OVER (PARTITION BY user_id % 4) AS first, us FROM p) SELECT iface::INTEGER AS iface, ((us - first) // 86400000000)::VARCHAR AS printed FROM n WHERE rn = total")
def pml_ticks(spark, sf):
    text = "int t; int i; TICK { t = t + 1; } { i = meta_get_inport(0); drop; } END { print t, \" \", i; }"
    out = pml.run(packets(spark, sf), text, key="in_iface", tick=86400.0).where("printed is not null")
    return out.select(F.regexp_extract("printed", " ([0-9]+)", 1).cast("int").alias("iface"), F.regexp_extract("printed", "^([0-9]+)", 1).alias("printed"))


def round_trip(spark, sf, kind: str) -> DataFrame:
    """Each packet as a record of a format, read again."""
    from wirelake.operators.edit import table_of
    from wirelake.schema import PACKET

    cut = {"xpkt": formats.read_xpkt, "pcap": lambda b: formats.read_pcap(formats.pcap_start() + b), "hex": lambda b: formats.read_hex(b.decode())}[kind]

    def fit(batches):
        for batch in batches:
            rows = [next(iter(cut(r))) | {"pkt_no": n} for n, r in zip(batch.column("pkt_no").to_pylist(), batch.column("record").to_pylist(), strict=True)]
            yield from table_of(rows, PACKET).to_batches()

    return readers.encoded(dealt(spark, sf), kind).mapInArrow(fit, PACKET)


@query("SELECT pkt_no, len, us, (user_id % 4)::INTEGER AS iface FROM p")
def xpkt_round_trip(spark, sf):
    out = round_trip(spark, sf, "xpkt")
    return out.select("pkt_no", F.length("data").cast("long").alias("len"), (F.col("ts_sec") * 1_000_000 + F.floor(F.col("ts_nsec") / 1000)).alias("us"), F.col("in_iface").alias("iface"))


@query("SELECT pkt_no, len, us FROM p")
def pcap_round_trip(spark, sf):
    out = round_trip(spark, sf, "pcap")
    return out.select("pkt_no", F.length("data").cast("long").alias("len"), (F.col("ts_sec") * 1_000_000 + F.floor(F.col("ts_nsec") / 1000)).alias("us"))


@query("SELECT pkt_no, len FROM p")
def hex_round_trip(spark, sf):
    return round_trip(spark, sf, "hex").select("pkt_no", F.length("data").cast("long").alias("len"))


def fields_of(name: str) -> None:
    """A query of all fields of one layout of ``synth_fields``."""

    def run(spark, sf):
        return synth_fields.dissected(with_pdus(synth_fields.packets(spark, sf, name)), name)

    run.__name__ = f"fields_{name}"
    query(synth_fields.sql(name))(run)


for _name in synth_fields.LAYOUTS:
    fields_of(_name)

"""Several streams: merge, mux, demux, split, concatenate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirelake.operators.order import ts


def concat(*streams: DataFrame) -> DataFrame:
    """Streams one after another; src_id is the stream's number."""
    out = None
    for k, s in enumerate(streams):
        s = s.withColumn("src_id", F.lit(k))
        out = s if out is None else out.unionByName(s)
    return out


def numbered(packets: DataFrame) -> DataFrame:
    """rr: a packet's place in its own stream, from 1."""
    return packets.withColumn("rr", F.row_number().over(Window.partitionBy("src_id").orderBy("pkt_no")).cast("long"))


def merge_round_robin(packets: DataFrame) -> DataFrame:
    """One packet of each stream in turn; a stream that has ended drops out. Adds rr and order."""
    return numbered(packets).orderBy("rr", "src_id")


def merge_time(packets: DataFrame) -> DataFrame:
    """By timestamp; packets without one, or earlier than one before them in their stream, go."""
    w = Window.partitionBy("src_id").orderBy("pkt_no").rowsBetween(Window.unboundedPreceding, -1)
    timed = packets.where("ts_sec is not null").withColumn("__t", ts(packets))
    kept = timed.withColumn("__m", F.max("__t").over(w)).where("__m is null or __t >= __m")
    return kept.orderBy("__t", "src_id", "pkt_no").drop("__t", "__m")


def _by_rounds(rows: DataFrame) -> DataFrame:
    """Order rows with ``round``: in a round each stream sends one packet of those due in turn, until none is left."""
    w = Window.partitionBy("src_id", "round").orderBy("pkt_no")
    return rows.withColumn("__sweep", F.row_number().over(w)).orderBy("round", "__sweep", "src_id").drop("__sweep")


def merge_proportional(packets: DataFrame) -> DataFrame:
    """Packets of each stream in proportion to its length. Adds round.

    Every round gives each stream credits of its number of packets, and a packet costs as many as the
    shortest stream has; a stream sends while it has that many. Rounds start with the first stream.
    """
    counts = packets.groupBy("src_id").agg(F.count(F.lit(1)).alias("__n"))
    counts = counts.withColumn("__cost", counts.agg(F.min("__n")).scalar())
    rows = numbered(packets).join(F.broadcast(counts), "src_id")
    return _by_rounds(rows.withColumn("round", F.expr("(rr * __cost + __n - 1) div __n")).drop("__n", "__cost", "rr"))


QUANTUM = 512


def merge_by_bytes(packets: DataFrame) -> DataFrame:
    """Bytes of each stream in proportion to all of its bytes: deficit round robin. Adds round.

    A stream's share of ``QUANTUM`` bytes a stream, at least one, is what each round lets it send more;
    a packet may start while the bytes sent before it are within that. Rounds start with the first stream.
    """
    size = F.length("data").cast("long")
    sums = packets.groupBy("src_id").agg(F.sum(size).alias("__b"))
    totals = sums.agg(F.struct(F.sum("__b").alias("b"), F.count(F.lit(1)).alias("n"))).scalar()
    sums = sums.withColumn("__t", totals)
    share = F.greatest(F.lit(1), F.floor(F.col("__b") / F.col("__t.b").cast("double") * (F.col("__t.n") * QUANTUM)).cast("long"))
    before = Window.partitionBy("src_id").orderBy("pkt_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = packets.withColumn("__sent", F.coalesce(F.sum(size).over(before), F.lit(0))).join(F.broadcast(sums.select("src_id", share.alias("__share"))), "src_id")
    return _by_rounds(rows.withColumn("round", F.expr("(__sent + __share - 1) div __share")).drop("__sent", "__share"))


def merge_random(packets: DataFrame, seed: int = 1, shares: dict[int, float] | None = None) -> DataFrame:
    """Weighted random interleaving that keeps each stream's order: exponential gaps, summed by stream."""
    shares = shares or {}
    share = F.coalesce(*[F.when(F.col("src_id") == k, F.lit(float(v))) for k, v in shares.items()], F.lit(1.0))
    u = (F.pmod(F.xxhash64(F.lit(seed), "src_id", "pkt_no"), F.lit(1 << 52)) + 1) / float(1 << 52)
    w = Window.partitionBy("src_id").orderBy("pkt_no").rowsBetween(Window.unboundedPreceding, 0)
    return packets.withColumn("__at", F.sum(-F.log(u) / share).over(w)).orderBy("__at", "src_id", "pkt_no").drop("__at")


def repeated(packets: DataFrame, times: int, most: int | None = None) -> DataFrame:
    """A stream played again and again; at most ``most`` packets."""
    out = packets.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return out if most is None else out.orderBy("round", "src_id", "pkt_no").limit(most)


def mux(*streams: DataFrame) -> DataFrame:
    """Streams as one, in_iface naming each; time order where packets have timestamps."""
    out = None
    for k, s in enumerate(streams):
        s = s.withColumn("in_iface", F.lit(k)).withColumn("src_id", F.lit(k))
        out = s if out is None else out.unionByName(s)
    return out.orderBy("ts_sec", "ts_nsec", "src_id", "pkt_no")


def demux(packets: DataFrame, ports: int, opened: set[int] | None = None) -> dict[int | str, DataFrame]:
    """A stream for each output interface; ``rest`` has packets without a usable one."""
    opened = set(range(ports)) if opened is None else opened
    out: dict[int | str, DataFrame] = {k: packets.where(F.col("out_iface") == k) for k in sorted(opened)}
    out["rest"] = packets.where(F.col("out_iface").isNull() | (F.col("out_iface") >= ports))
    return out


def split_by_flow(packets: DataFrame, path: str, prefix: str = "", append: bool = False, strip: bool = False, kind: str = "parquet") -> None:
    """Packets by flow id below path, ``nofid`` for those without; refuses an existing path unless append.

    ``parquet`` writes a folder for each flow; ``xpkt`` and ``pcap`` write a file for each, in packet order.
    """
    name = F.concat(F.lit(prefix), F.coalesce(F.col("flow_id").cast("string"), F.lit("nofid")))
    rows = packets.withColumn("flow", name)
    if strip:
        rows = rows.withColumn("flow_id", F.lit(None).cast("long"))
    if kind == "parquet":
        rows.write.partitionBy("flow").mode("append" if append else "errorifexists").parquet(path)
        return
    from wirelake.sources.readers import write_by_name

    write_by_name(rows, "flow", path, kind, append)

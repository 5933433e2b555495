"""Operators that depend on arrival order (src_id, pkt_no): filter, count, head, tail, range, sort, time.

Running totals over all streams are taken by blocks of consecutive packets, by blocks of blocks, and
within them, so that no task gets all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelake.functions.bytesx import be_bytes
from wirelake.functions.fields import field
from wirelake.functions.registry import FIELDS

#: Consecutive packets of a block; a task may get one, so small enough for many tasks.
BLOCK = 1 << 13


def keep(packets: DataFrame, predicate: Column) -> DataFrame:
    """Packets for which a predicate holds; null counts as false."""
    return packets.where(F.coalesce(predicate, F.lit(False)))


def count(packets: DataFrame, *by: Column, quiet: bool = False) -> DataFrame:
    """Packets, and unless quiet bytes, for the whole stream or by columns."""
    aggs = [F.count(F.lit(1)).alias("packets")] + ([] if quiet else [F.coalesce(F.sum(F.length("data")), F.lit(0)).alias("bytes")])
    return packets.groupBy(*by).agg(*aggs)


PLACE = ("src_id", "pkt_no")


def place(desc: bool = False) -> list[Column]:
    return [F.desc(c) if desc else F.asc(c) for c in PLACE]


def _blocks(rows: DataFrame, order: tuple[str, str], block: int) -> DataFrame:
    """Add __b and __bb: a row's block of consecutive packets of its stream, and that block's block."""
    rows = rows.withColumn("__b", F.floor(F.col(order[1]) / block))
    return rows.withColumn("__bb", F.floor(F.col("__b") / block))


def _before(rows: DataFrame, agg: Column, carried, order: tuple[str, str]) -> DataFrame:
    """(stream, __b, __base): carried(value, window) over all blocks before each, in two levels so that no task gets all blocks."""
    stream = order[0]
    blocks = rows.groupBy(stream, "__bb", "__b").agg(agg.alias("__s"))
    tops = blocks.groupBy(stream, "__bb").agg(carried("__s", None, "__b").alias("__t"))
    outer = Window.orderBy(stream, "__bb").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(F.col(stream).alias("__ts"), F.col("__bb").alias("__tb"), carried("__t", outer).alias("__far"))
    inner = Window.partitionBy(stream, "__bb").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    near = blocks.withColumn("__near", carried("__s", inner))
    both = near.join(tops, (F.col(stream) == F.col("__ts")) & (F.col("__bb") == F.col("__tb")))
    return both.select(F.col(stream).alias("__ks"), F.col("__b").alias("__kb"), "__near", "__far")


def running(rows: DataFrame, value: Column, name: str, order: tuple[str, str] = PLACE, block: int = BLOCK, inclusive: bool = True) -> DataFrame:
    """Add the running sum of value in order of a stream's number and a place in it, which may not be null."""
    stream, at = order
    marked = _blocks(rows.withColumn("__v", value), order, block)

    def carried(c: str, w, by: str | None = None) -> Column:
        return F.sum(c) if w is None else F.sum(c).over(w)

    base = _before(marked, F.sum("__v"), carried, order)
    inside = Window.partitionBy(stream, "__b").orderBy(at).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = marked.join(base, (F.col(stream) == F.col("__ks")) & (F.col("__b") == F.col("__kb")))
    parts = [F.coalesce(c, F.lit(0)) for c in (F.col("__far"), F.col("__near"), F.sum("__v").over(inside))]
    return out.withColumn(name, parts[0] + parts[1] + parts[2]).drop("__v", "__b", "__bb", "__ks", "__kb", "__near", "__far")


def last_marker(rows: DataFrame, marker: Column, name: str, order: tuple[str, str] = PLACE, block: int = BLOCK, inclusive: bool = True) -> DataFrame:
    """Add the last non-null marker up to a row (before it, unless inclusive), over all streams in order."""
    stream, at = order
    marked = _blocks(rows.withColumn("__m", marker), order, block)

    def carried(c: str, w, by: str | None = None) -> Column:
        return F.max(F.when(F.col(c).isNotNull(), F.struct(by, c)))[c] if w is None else F.last(c, ignorenulls=True).over(w)

    base = _before(marked, F.max(F.when(F.col("__m").isNotNull(), F.struct(at, "__m")))["__m"], carried, order)
    inside = Window.partitionBy(stream, "__b").orderBy(at).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = marked.join(base, (F.col(stream) == F.col("__ks")) & (F.col("__b") == F.col("__kb")))
    return out.withColumn(name, F.coalesce(F.last("__m", ignorenulls=True).over(inside), "__near", "__far")).drop("__m", "__b", "__bb", "__ks", "__kb", "__near", "__far")


def head(packets: DataFrame, n: int = 10) -> DataFrame:
    return packets.orderBy(*place()).limit(n)


def tail(packets: DataFrame, n: int = 10) -> DataFrame:
    return packets.orderBy(*place(desc=True)).limit(n).orderBy(*place())


def reverse(packets: DataFrame) -> DataFrame:
    return packets.orderBy(*place(desc=True))


def first_matching(packets: DataFrame, predicate: Column, n: int) -> DataFrame:
    """The first n packets for which a predicate holds."""
    return keep(packets, predicate).orderBy(*place()).limit(n)


def places(ordered: DataFrame, name: str = "place") -> DataFrame:
    """Number the rows of an ordered table from 1 in the order they would be written.

    An index over partitions needs their sizes first, which no DataFrame operation gives for one and
    the same run of a sort; so the rows pass as an RDD. Keep only narrow columns before.
    """
    schema = T.StructType([*ordered.schema.fields, T.StructField(name, T.LongType())])
    return ordered.sparkSession.createDataFrame(ordered.rdd.zipWithIndex().map(lambda x: (*x[0], x[1] + 1)), schema)


def in_range(packets: DataFrame, start: Column | int | str, end: Column | int | str | None = None, multiple: bool = False) -> DataFrame:
    """Packets of ranges: a start and an end, each a packet number, ANY, NONE or a predicate.

    The end packet belongs to its range. Without ``multiple`` only the first complete range is kept.
    """

    def test(x) -> Column:
        if isinstance(x, Column):
            return F.coalesce(x, F.lit(False))
        return F.lit({"ANY": True, "NONE": False}[x]) if isinstance(x, str) else F.col("pkt_no") == x

    s = test(start)
    e = s if end is None else test(end)
    marked = packets.withColumn("__s", s).withColumn("__e", e)
    rows = last_marker(marked, F.when(F.col("__e"), F.lit(0)).when(F.col("__s"), F.lit(1)), "__open", inclusive=False)
    rows = rows.withColumn("__in", F.col("__s") | (F.coalesce("__open", F.lit(0)) == 1))
    if not multiple:
        stop = rows.where("__in and __e").agg(F.min(F.struct(*PLACE)).alias("__stop")).scalar()
        rows = rows.where(F.coalesce(F.struct(*PLACE) <= stop, F.lit(True)))
    return rows.where("__in").select(*packets.columns)


SORT_TAGS = {"timestamp": None, "flowid": "flow_id", "class": "class", "seq": "seq"}


def key_bytes(name: str) -> Column:
    """A sort key's bytes, empty where the packet lacks it."""
    if name.startswith("xpkt."):
        tag = name[5:]
        if tag == "timestamp":
            made = F.concat(be_bytes(F.col("ts_sec"), 4), be_bytes(F.col("ts_nsec"), 4))
        elif tag.lstrip("+*").startswith("appinfo"):
            made = F.get(F.col("appinfo"), F.lit(0))["data"]
        else:
            made = be_bytes(F.col(SORT_TAGS[tag]), 8)
    else:
        f = FIELDS.get(name)
        made = be_bytes(field(name), (f.size + 7) // 8) if f is not None and f.kind == "bits" else field(name)
    return F.coalesce(made, F.lit(b""))


def sort_key(names: list[str]) -> Column:
    """Keys one after another in 64 zero-filled bytes; a missing key takes no place."""
    return F.rpad(F.substring(F.concat(*map(key_bytes, names)), 1, 64), 64, F.lit(b"\0"))


def sort(packets: DataFrame, names: list[str] | None = None, reverse: bool = False, strict: bool = False) -> DataFrame:
    """Order by fields; ties keep arrival order. ``strict`` fails on a packet without some key."""
    names = names or ["xpkt.timestamp"]
    if len(names) > 256:
        raise ValueError("at most 256 sort keys")
    key = sort_key(names)
    if strict:
        whole = F.concat(*map(key_bytes, names))
        bad = F.greatest(*[F.length(key_bytes(n)) == 0 for n in names], F.lit(False)) | (F.length(whole) > 64)
        key = F.when(bad, F.raise_error(F.lit("a sort key is missing or too long"))).otherwise(key)
    k = F.col("__key")
    return packets.withColumn("__key", key).orderBy(k.desc() if reverse else k.asc(), "src_id", "pkt_no").drop("__key")


def ts(packets: DataFrame) -> Column:
    """Nanoseconds since the epoch."""
    return F.col("ts_sec") * 1_000_000_000 + F.coalesce("ts_nsec", F.lit(0))


def scale_time(packets: DataFrame, factor: float) -> DataFrame:
    """Distances from the first timestamp times factor, in milliseconds; packets without one go."""
    timed = packets.where("ts_sec is not null").withColumn("__t", ts(packets))
    rows = timed.withColumn("__t0", timed.agg(F.min_by("__t", F.struct(*PLACE))).scalar())
    ms = F.floor((F.col("__t") - F.col("__t0")) / 1_000_000).cast("double") * F.lit(float(factor))
    new = F.col("__t0") + F.floor(ms).cast("long") * 1_000_000
    return rows.withColumn("__n", new).withColumn("ts_sec", F.floor(F.col("__n") / 1_000_000_000)).withColumn("ts_nsec", F.pmod("__n", F.lit(1_000_000_000)).cast("int")).select(*packets.columns)


def release_times(packets: DataFrame, interval: float | None = None, pps: float | None = None, bps: float | None = None, delay: float = 0.0) -> DataFrame:
    """Add release_at, seconds from the start: by interval, packets or bits a second, or timestamps."""
    if interval is not None or pps is not None:
        step = interval if interval is not None else 1.0 / pps
        return running(packets, F.lit(1), "__n", inclusive=False).withColumn("release_at", F.lit(delay) + F.col("__n") * F.lit(float(step))).drop("__n")
    if bps is not None:
        return running(packets, F.length("data").cast("long") * 8, "__bits", inclusive=False).withColumn("release_at", F.lit(delay) + F.col("__bits") / F.lit(float(bps))).drop("__bits")
    first = packets.where("ts_sec is not null").agg(F.min_by(ts(packets), F.struct(*PLACE))).scalar()
    return packets.withColumn("release_at", F.lit(delay) + F.coalesce((ts(packets) - first) / 1e9, F.lit(0.0)))

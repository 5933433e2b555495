"""Structured Streaming operators: flow tracking, reassembly input checks, windows, programs with state."""

from __future__ import annotations

import pickle

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wirelake.operators.edit import frame_of
from wirelake.operators.flows import TIMEOUT
from wirelake.plans.pml.interpret import TICK, Machine, seconds
from wirelake.plans.pml.parse import parse
from wirelake.schema import PACKET

KEY = ["family", "proto", "lo", "hi"]
FLOW = T.StructType([
    T.StructField("event", T.StringType()), T.StructField("family", T.LongType()), T.StructField("proto", T.LongType()), T.StructField("client", T.BinaryType()), T.StructField("server", T.BinaryType()),
    T.StructField("start_ns", T.LongType()), T.StructField("last_ns", T.LongType()), T.StructField("c2s_pkts", T.LongType()), T.StructField("c2s_bytes", T.LongType()), T.StructField("s2c_pkts", T.LongType()), T.StructField("s2c_bytes", T.LongType()),
])
STATE = "client binary, server binary, start_ns long, last_ns long, c2s_pkts long, c2s_bytes long, s2c_pkts long, s2c_bytes long"


def flow_events(keyed: DataFrame, timeout: float = TIMEOUT, late: str = "0 seconds") -> DataFrame:
    """START, UPDATE (once a batch) and END rows of a stream of packets with ``flows.header_key`` columns.

    A flow ends when the watermark is timeout seconds past its last packet, or when a packet comes
    after such a gap. Packets of a batch are taken in pkt_no order.
    """
    gap = int(timeout * 1_000_000_000)
    rows = keyed.where("a is not null").select(
        F.timestamp_seconds("ts_sec").alias("at"), "pkt_no", "family", "proto", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "a", "b",
        (F.col("ts_sec") * 1_000_000_000 + F.coalesce("ts_nsec", F.lit(0))).alias("ns"), F.length("data").alias("size"),
    ).withWatermark("at", late)

    def row(event: str, key: tuple, s: list) -> tuple:
        return (event, key[0], key[1], s[0], s[1], s[2], s[3], *s[4:])

    def step(key: tuple, batches, state: GroupState):
        out = []
        if state.hasTimedOut:
            out.append(row("END", key, list(state.get)))
            state.remove()
        else:
            pdf = pd.concat(list(batches)).sort_values("pkt_no")
            s = list(state.get) if state.exists else None
            for r in pdf.itertuples(index=False):
                if s is not None and r.ns - s[3] >= gap:
                    out.append(row("END", key, s))
                    s = None
                if s is None:
                    s = [bytes(r.a), bytes(r.b), int(r.ns), int(r.ns), 0, 0, 0, 0]
                    out.append(row("START", key, s))
                way = 4 if bytes(r.a) == s[0] else 6
                s[3], s[way], s[way + 1] = max(s[3], int(r.ns)), s[way] + 1, s[way + 1] + int(r.size)
            out.append(row("UPDATE", key, s))
            state.update(tuple(s))
            state.setTimeoutTimestamp(max(s[3] // 1_000_000 + int(timeout * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=FLOW.names)

    return rows.groupBy(*KEY).applyInPandasWithState(step, FLOW, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def counts(packets: DataFrame, width: str = "1 minute", late: str = "10 seconds") -> DataFrame:
    """Packets and bytes of tumbling windows; the periodic form of count."""
    timed = packets.withColumn("at", F.timestamp_seconds("ts_sec")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width)).agg(F.count(F.lit(1)).alias("packets"), F.sum(F.length("data")).alias("bytes"))


def sessions(keyed: DataFrame, gap: str = "60 seconds", late: str = "10 seconds") -> DataFrame:
    """Packets of sessions of each pair of endpoints, by Spark's own session windows."""
    timed = keyed.where("a is not null").withColumns({"at": F.timestamp_seconds("ts_sec"), "lo": F.least("a", "b"), "hi": F.greatest("a", "b")}).withWatermark("at", late)
    return timed.groupBy("family", "proto", "lo", "hi", F.session_window("at", gap)).agg(F.count(F.lit(1)).alias("packets"))


#: The columns a program sees of a packet in a stream, tags as text so that they stay exact beside nulls.
TAGGED = [f for f in PACKET if f.name not in ("parseinfo", "appinfo")]
PRINTED = T.StructType([*TAGGED, T.StructField("sub_no", T.LongType()), T.StructField("printed", T.StringType())])


def programs(packets: DataFrame, text: str, key: str, load=None, on_error: str = "abort", tick: float = TICK, idle: str | None = None, late: str = "0 seconds") -> DataFrame:
    """What a program of the pattern language sends and prints over a stream, with state for each key.

    Variables, lists and the clock of a key's program are kept from batch to batch; BEGIN runs with the
    key's first packet. With ``idle``, END runs when the watermark is that far past the key's last packet,
    and its state goes. Packets of a batch are taken in (src_id, pkt_no) order. sub_no counts in a batch.
    """
    program = parse(text, load)
    numbers = [f.name for f in TAGGED if f.dataType in (T.LongType(), T.IntegerType())]
    rows = packets.select(*[F.col(f.name).cast("string").alias(f.name) if f.name in numbers else F.col(f.name) for f in TAGGED], F.col(key).cast("string").alias("__key"), F.timestamp_seconds("ts_sec").alias("__at"))
    wait = pd.Timedelta(idle).total_seconds() if idle else None
    if idle:
        rows = rows.withWatermark("__at", late)

    def step(key: tuple, batches, state: GroupState):
        m, out, last = Machine(program, on_error), [], 0.0
        if state.exists:
            m.vars, m.lists, m.next_tick, last = pickle.loads(state.get[0])  # noqa: S301
        else:
            m.entry("BEGIN")

        def drain():
            out.extend({f.name: r.get(f.name) for f in TAGGED} | {"sub_no": len(out), "printed": None} for r in m.out)
            out.extend(dict.fromkeys(f.name for f in TAGGED) | {"sub_no": len(out), "printed": line} for line in m.text)
            m.out, m.text = [], []

        if state.hasTimedOut:
            m.entry("END")
            state.remove()
        else:
            own = [r for pdf in batches for r in pdf.to_dict("records")]
            own = [{f.name: None if r[f.name] is None else int(r[f.name]) if f.name in numbers else r[f.name] for f in TAGGED} for r in own]
            for row in sorted(own, key=lambda r: (r["src_id"] or 0, r["pkt_no"])):
                last = max(last, seconds(row) or 0.0)
                if not m.tick_until(seconds(row), tick) or not m.feed(row):
                    break
                drain()
            state.update((pickle.dumps((m.vars, m.lists, m.next_tick, last)),))
            if wait is not None:
                state.setTimeoutTimestamp(max(int((last + wait) * 1000), state.getCurrentWatermarkMs() + 1))
        drain()
        yield frame_of(out, PRINTED)

    timeout = GroupStateTimeout.EventTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return rows.groupBy("__key").applyInPandasWithState(step, PRINTED, "machine binary", "append", timeout)

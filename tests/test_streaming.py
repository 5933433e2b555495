"""Operators on Structured Streaming against the same packets in batches."""

import os

import pytest
from pyspark.sql import functions as F

from wirelake.functions.dissect import with_headers
from wirelake.operators import edit, flows
from wirelake.plans import pml
from wirelake.schema import ETH, PACKET
from wirelake.streaming import trackers

BIG = (1 << 60) + 1


def packet(no, user, at, back=False, flow_id=None):
    ends = {"ip.saddr": bytes([10, 0, 0, user]), "tcp.sport": 1000 + user}
    if back:
        ends = {"ip.daddr": bytes([10, 0, 0, user]), "tcp.dport": 1000 + user, "ip.saddr": bytes([10, 0, 0, 2])}
    p = edit.make("tcp", b"x" * user, ends)
    return (no, 0, ETH, at, 0, None, user % 2, None, flow_id, None, None, None, None, bytes(p.data))


PARTS = [
    [packet(1, 7, 100), packet(2, 8, 101), packet(3, 7, 102, True)],
    [packet(4, 8, 110, flow_id=BIG), packet(5, 7, 111)],
    [packet(6, 7, 300), packet(7, 9, 301)],
    [packet(8, 9, 1000)],
]


@pytest.fixture
def arriving(spark, tmp_path):
    """A stream that gets one part a batch."""
    for k, part in enumerate(PARTS):
        spark.createDataFrame(part, PACKET).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    files = sorted(p for k in range(len(PARTS)) for p in (tmp_path / "in" / str(k)).glob("*.parquet"))
    (tmp_path / "flat").mkdir()
    for k, p in enumerate(files):
        p.rename(tmp_path / "flat" / f"{k}.parquet")
        os.utime(tmp_path / "flat" / f"{k}.parquet", (1000 + k, 1000 + k))
    return spark.readStream.schema(PACKET).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/flat")


def collected(out, tmp_path):
    q = out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/out")
    q.awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()


def test_flow_events(spark, arriving, tmp_path):
    got = collected(trackers.flow_events(flows.header_key(with_headers(arriving)), timeout=60), tmp_path)
    starts = sorted((bytes(r.client)[3], r.start_ns // 10**9) for r in got if r.event == "START")
    assert starts == [(7, 100), (7, 300), (8, 101), (9, 301), (9, 1000)]
    ends = {(bytes(r.client)[3], r.start_ns // 10**9): (r.c2s_pkts, r.s2c_pkts) for r in got if r.event == "END"}
    assert ends[7, 100] == (2, 1) and ends[8, 101] == (2, 0)
    batch = flows.stats(flows.track(flows.header_key(with_headers(spark.createDataFrame([r for p in PARTS for r in p], PACKET))), 60.0), 60.0).collect()
    assert sorted((bytes(r.client)[3], int(r.start)) for r in batch) == starts


def test_windows_of_counts(spark, arriving, tmp_path):
    got = {r.window.start.timestamp(): (r.packets, r.bytes) for r in collected(trackers.counts(arriving, "1 minute", "1 second"), tmp_path)}
    rows = [r for p in PARTS for r in p]
    want = {}
    for r in rows:
        n, b = want.get(r[3] // 60 * 60, (0, 0))
        want[r[3] // 60 * 60] = (n + 1, b + len(r[-1]))
    assert {k: v for k, v in want.items() if k < 960} == got


def test_sessions(arriving, tmp_path):
    got = collected(trackers.sessions(flows.header_key(with_headers(arriving)), "60 seconds", "1 second"), tmp_path)
    assert sorted(r.packets for r in got) == [1, 1, 2, 3]


def test_programs_keep_their_state(spark, arriving, tmp_path):
    text = 'int n; int t; BEGIN { print "begin"; } TICK { t = t + 1; } { n = n + 1; print "n=", n, " t=", t; } END { print "end ", n; }'
    got = collected(trackers.programs(arriving, text, "in_iface", tick=100.0, idle="300 seconds"), tmp_path)
    said = [r.printed for r in got if r.printed is not None]
    assert said.count("begin") >= 2 and sum(x.startswith("n=") for x in said) == 8 and any(x.startswith("end ") for x in said)
    sent = {r.pkt_no: r.flow_id for r in got if r.printed is None}
    assert sorted(sent) == list(range(1, 9)) and sent[4] == BIG and sent[5] is None
    batch = pml.run(spark.createDataFrame([r for p in PARTS for r in p], PACKET), text, key="in_iface", tick=100.0)
    numbered = sorted(r.printed for r in batch.where(F.col("printed").startswith("n=")).collect())
    assert sorted(x for x in said if x.startswith("n=")) == numbered

"""Checksums of made packets, and fragments beside packets that aren't."""

from pyspark.sql import functions as F

from wirelake.functions import bytesx as B
from wirelake.functions.dissect import with_pdus
from wirelake.operators import fragments
from wirelake.operators.edit import Packet
from wirelake.synth import packets

SF = "/root/testdata/sf0.001"


def test_made_packets_have_right_checksums(spark):
    rows = packets(spark, SF, checksums=True)
    got = {r.pkt_no: bytes(r.data) for r in rows.collect()}
    bare = {r.pkt_no: bytes(r.data) for r in packets(spark, SF).collect()}
    for k, d in bare.items():
        p = Packet(d)
        p.fix_csums(p.find("ip"))
        assert got[k] == bytes(p.data)
    plan = rows.where(F.substring("data", 19, 2) != F.lit(b"\0\0"))._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and plan.count("props") < 12


def test_sums_of_bytes(spark):
    rows = spark.createDataFrame([(b"",), (b"\0\0",), (b"\xff\xff",), (b"\xff\xff\0\1",), (b"\1",), (b"\x12\x34\x56",)], "d binary")
    assert [r.s for r in rows.select(B.ones_sum(F.col("d")).alias("s")).collect()] == [0, 0, 0xFFFF, 1, 0x100, 0x1234 + 0x5600]


def test_packets_pass_in_the_same_run(spark):
    """Each packet is cut and dissected once, and whole ones come out beside reassembled ones."""
    base = packets(spark, SF, checksums=True, even=True).where("pkt_no > 1")
    cut = fragments.fragment(base, mtu=48, df="fragment")
    assert {r.n for r in cut.groupBy("pkt_no").agg(F.count(F.lit(1)).alias("n")).collect()} == {1, 2}
    out = fragments.reassemble(with_pdus(cut.withColumn("at", -F.col("sub_no"))), order=("pkt_no", "at"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert {r.pkt_no: bytes(r.data) for r in out.collect()} == {r.pkt_no: bytes(r.data) for r in base.collect()}

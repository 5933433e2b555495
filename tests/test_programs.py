"""Programs over whole streams: what is kept from packet to packet, and what a worker holds."""

import pytest
from pyspark.sql import functions as F

from wirelake.operators import edit
from wirelake.plans import pml
from wirelake.plans.pml import interpret
from wirelake.plans.pml.parse import parse
from wirelake.plans.pml.state import independent
from wirelake.schema import EMPTY_TAGS

ALONE = [
    "{ print ip.id; }", "int n; { n = 1; print n; }", "int n; { n = n + 1; send; }", '{ rand_init("Key"); print rand_byte(), rand_i; }', "int n; int f() { return n; } { n = 3; print f(); }",
    'str b[4] = "abcd"; { b[0, 1] = "x"; print b; b = "abcd"; }', "{ int k; k = k + 1; print k; pkt_copy(1, 0); }",
]
KEPT = [
    "int n; { print n; n = n + 1; }", "int n; ?- tcp -? { n = 1; } { print n; }", "int n; { if (tcp) n = 1; print n; }", "{ print rand_byte(); }", "{ pkt_enq(3, 0); }", "{ exit(0); }", "{ print 1, ; }",
    "int n; { nextrule; n = 1; } { print n; }", "int n; int f() { return n; } { print f(); n = n + 1; }", 'str b[4] = "abcd"; { b[0, 1] = "x"; print b; }', 'str b[4] = "abcd"; { b[0, 1] = "x"; drop; b = "abcd"; }',
    'str b[4] = "abcd"; { b[0, 1] = "x"; b = "abce"; }', "{ global int q; q = q + 1; print q; }", "int n; { n = n + ip.id; }", "{ } END { print 1; }", "int t; TICK { t = t + 1; } { }", "int n; { n = n / 0; }", "str r; { print r; &r = tcp; }",
]


def stream(spark, n=400, keys=3, parts=4):
    rows = [EMPTY_TAGS | {"pkt_no": k, "src_id": 0, "dltype": 0x0201, "in_iface": k % keys or None, "data": bytes(edit.make("tcp" if k % 2 else "udp", b"x" * (k % 5), {"ip.id": k}).data)} for k in range(n, 0, -1)]
    return spark.createDataFrame(rows, edit.PACKET).repartition(parts)


@pytest.mark.parametrize("text", ALONE)
def test_programs_that_keep_nothing(text):
    assert independent(parse(text))


@pytest.mark.parametrize("text", KEPT)
def test_programs_that_keep_something(text):
    assert not independent(parse(text))


@pytest.mark.parametrize("text", ['int n; { print ip.id + 0; send_no_free 0; }', 'str b[4] = "abcd"; { b[0, 1] = ip.id % 100 + 1; print %hex% b; b = "abcd"; }', '?- tcp -? { rand_init("K"); ip.ttl = rand_byte(); } ?- udp -? { drop; }'])
@pytest.mark.parametrize("key", ["in_iface", None])
def test_packets_alone_give_what_streams_give(spark, monkeypatch, text, key):
    rows = stream(spark)
    alone = sorted(map(str, pml.run(rows, text, key=key).collect()))
    monkeypatch.setattr(interpret, "independent", lambda *a: False)
    assert alone == sorted(map(str, pml.run(rows, text, key=key).collect())) and alone


def test_unused_numbers_cost_no_shuffle(spark):
    plan = pml.run(stream(spark, 4), "{ print ip.id; drop; }", key="in_iface").where("printed is not null").select("printed")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_a_stream_passes_in_parts(spark):
    """A worker sees 50 packets of a key at a time; the program, all of them in order."""
    rows = stream(spark, 1000, keys=2, parts=1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        out = pml.run(rows, 'int n; { n = n + 1; print n, " ", ip.id + 0; if (n == 300) exit(0); } END { print "end ", n; }', key="in_iface")
        assert "FlatMapGroups" not in out._jdf.queryExecution().optimizedPlan().toString()
        got = out.where(F.col("printed").isNotNull()).orderBy("sub_no").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r.printed for r in got) == sorted([f"{n} {2 * n - k}" for n in range(1, 301) for k in (0, 1)] + ["end 300"] * 2)
    assert [r.printed for r in got][-2:] == ["end 300"] * 2


def test_events_are_dealt_before_python_gets_them(spark):
    """A file of one part no longer means one task for tunnels, hex text and dissection."""
    from wirelake.plans import catalogue

    sf = "/root/testdata/sf0.001"
    for name in ("encap_decap_gre", "encap_decap_vxlan", "hex_round_trip", "pml_strings"):
        plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        below = plan[plan.rindex("MapInArrow") :]
        assert "RepartitionByExpression" in below, name
    assert catalogue.dealt(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism

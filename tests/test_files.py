"""Packet files: written, read again, in order, and what is refused."""

import pytest

from wirelake.operators import edit, streams
from wirelake.schema import ETH, PACKET
from wirelake.sources import formats, readers


def rows(spark, n=40):
    made = [edit.make("udp", bytes([k])) for k in range(n)]
    table = [(k + 1, 0, ETH, 100 + k, k * 1000, None, k % 3, None, (1 << 60) + k if k % 2 else None, None, None, [(256, 14, 20)] if k == 3 else None, [(128, 5, b"abcd")] if k == 4 else None, bytes(p.data)) for k, p in enumerate(made)]
    return spark.createDataFrame(table, PACKET).repartition(3)


@pytest.mark.parametrize("kind", ["xpkt", "pcap", "hex"])
def test_files_hold_the_packets_in_order(spark, tmp_path, kind):
    table, path = rows(spark), f"{tmp_path}/out"
    readers.write_packets(table, path, kind)
    got = readers.read_written(spark, path, kind).orderBy("src_id", "pkt_no").collect()
    want = table.orderBy("pkt_no").collect()
    assert [bytes(r.data) for r in got] == [bytes(r.data) for r in want]
    if kind != "hex":
        assert [(r.ts_sec, r.ts_nsec) for r in got] == [(r.ts_sec, r.ts_nsec) for r in want]
    if kind == "xpkt":
        assert [(r.flow_id, r.in_iface, r.parseinfo, r.appinfo) for r in got] == [(r.flow_id, r.in_iface, r.parseinfo, r.appinfo) for r in want]
    with pytest.raises(Exception, match="(?i)exist"):
        readers.write_packets(table, path, kind)


def test_a_written_capture_is_one(spark, tmp_path):
    readers.write_packets(rows(spark, 5).coalesce(1), f"{tmp_path}/c", "pcap")
    (tmp_path / "all").write_bytes(b"".join(p.read_bytes() if k == 0 else p.read_bytes()[24:] for k, p in enumerate(sorted((tmp_path / "c").glob("part-*.pcap")))))
    assert [r["data"][-1] for r in formats.read_pcap((tmp_path / "all").read_bytes())] == list(range(5))
    assert not list((tmp_path / "c").glob("_temporary"))


def test_raw_files_and_odd_ones(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    for k in range(2):
        (tmp_path / "raw" / f"{k}.bin").write_bytes(bytes([k]) * 5)
    got = readers.read_raw(spark, f"{tmp_path}/raw").orderBy("src_id").collect()
    assert [(r.src_id, bytes(r.data)) for r in got] == [(0, bytes(5)), (1, b"\1" * 5)]
    (tmp_path / "bad").write_bytes(b"no capture at all, but long enough to look at")
    with pytest.raises(Exception, match="not a PCAP file"):
        readers.read_pcap(spark, f"{tmp_path}/bad").collect()


def test_a_file_for_each_flow(spark, tmp_path):
    streams.split_by_flow(rows(spark, 9), f"{tmp_path}/flows", kind="xpkt", prefix="f")
    names = sorted(p.name for p in (tmp_path / "flows").iterdir())
    assert names[-1] == "fnofid.xpkt" and len(names) == 5
    assert [r["data"][-1] for r in formats.read_xpkt((tmp_path / "flows" / "fnofid.xpkt").read_bytes())] == [0, 2, 4, 6, 8]

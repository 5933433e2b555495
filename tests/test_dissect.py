"""Dissection of whole columns against the parsers, packet by packet."""

import random

import pyarrow as pa

from wirelake.functions import dissect
from wirelake.operators import edit
from wirelake.schema import ETH


def packets(n=3000):
    rng = random.Random(5)
    for k in range(n):
        p = edit.make(rng.choice(["tcp", "udp", "icmp", "icmp", "arp", "icmp6"]), b"" if k % 7 == 0 else bytes(rng.randrange(256) for _ in range(rng.randrange(40))))
        if p.find("udp") is not None and k % 3 == 0:
            p.set("udp.dport", rng.choice([4789, 6635, 53]))
            p.data[p.find("udp").soff + 6 : p.find("udp").soff + 8] = rng.choice([b"\0\0", b"\xff\xff", b"\x12\x34"])
        if k % 11 == 0:
            p.vlan_push(5)
        raw = bytearray(p.data)
        for _ in range(rng.choice([0, 0, 1, 3])):
            raw[rng.randrange(12, len(raw))] = rng.choice([0, 1, 0x45, 0x46, 0x50, 0x60, 0xFF, rng.randrange(256)])
        raw = raw[: rng.choice([len(raw), len(raw), rng.randrange(len(raw) + 1)])] + bytes(rng.choice([0, 0, 6]))
        yield (None if k % 97 == 0 else bytes(raw)), (0x0200 if k % 31 == 0 else ETH)


def test_columns_equal_the_parsers(monkeypatch):
    monkeypatch.setattr(dissect, "SUMMED", 5000)
    data, kinds = zip(*packets(), strict=True)
    got = dissect._units(pa.array(data, pa.binary())[5:], pa.array(kinds, pa.int32())[5:]).to_pylist()
    want = [dissect.as_rows(dissect.dissect_bytes(d, t)) if d is not None else [] for d, t in zip(data[5:], kinds[5:], strict=True)]
    for g, w in zip(got, want, strict=True):
        assert [u | {"xoffs": dict(u["xoffs"])} for u in g] == w
    assert dissect._units(pa.array([], pa.binary()), pa.array([], pa.int32())).to_pylist() == []


def test_common_packets_skip_the_parsers(monkeypatch):
    made = [bytes(edit.make(kind, b"hello").data) for kind in ("tcp", "udp", "icmp")] * 50
    want = [dissect.as_rows(dissect.dissect_bytes(d, ETH)) for d in made]
    monkeypatch.setattr(dissect, "dissect_bytes", None)
    got = dissect._units(pa.array(made), pa.array([ETH] * len(made), pa.int32())).to_pylist()
    assert [[u | {"xoffs": dict(u["xoffs"])} for u in g] for g in got] == want

"""Record formats, packet editing and the pattern language on single packets."""

import struct

import pytest

from wirelake.functions.dissect import dissect_bytes
from wirelake.operators import edit, order
from wirelake.plans import pml
from wirelake.plans.pml.parse import PmlError
from wirelake.schema import CKSUM, EMPTY_TAGS, ETH
from wirelake.sources import formats


def tagged(data=b"abcd"):
    return EMPTY_TAGS | {"pkt_no": 1, "src_id": 0, "dltype": ETH, "ts_sec": 5, "ts_nsec": 7, "wirelen": 99, "in_iface": 3, "out_iface": 4, "flow_id": -1, "class": 2, "seq": 9, "parseinfo": [(6, 14, 20)], "appinfo": [(200, 1, b"wxyz")], "data": data}


def test_xpkt_round_trip_and_errors():
    row = tagged()
    raw = formats.write_xpkt(row)
    assert list(formats.read_xpkt(raw + raw)) == [row, row | {"pkt_no": 2}]
    for bad in (raw[:-1], b"\0\0\0\x04\0\0\0\0", raw[:5]):
        with pytest.raises(ValueError):
            list(formats.read_xpkt(bad))
    twice = struct.pack(">BBH", 3, 0, 1) * 2
    with pytest.raises(ValueError):
        list(formats.read_xpkt(struct.pack(">IHH", 8 + len(twice), ETH, 2) + twice))


def test_pcap_in_either_byte_order():
    raw = formats.pcap_start() + formats.write_pcap(tagged())
    row = next(formats.read_pcap(raw))
    assert (row["ts_sec"], row["wirelen"], row["data"]) == (5, 99, b"abcd")
    swapped = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65536, 1) + struct.pack("<IIII", 1, 2, 2, 2) + b"hi"
    row = next(formats.read_pcap(swapped))
    assert (row["ts_sec"], row["ts_nsec"], row["wirelen"], row["data"]) == (1, 2000, None, b"hi")
    with pytest.raises(ValueError):
        list(formats.read_pcap(b"nope" * 10))


def test_hex_text():
    text = "# a comment\n0000: 01 02 03\n0003: 04\n\n\n05 06 # tail\n"
    assert [r["data"] for r in formats.read_hex(text, strict=True)] == [b"\1\2\3\4", b"\5\6"]
    with pytest.raises(ValueError):
        list(formats.read_hex("0001: 01\n", strict=True))
    p = edit.make("udp", b"payload")
    again = next(formats.read_hex(formats.to_hex({"pkt_no": 1, "dltype": p.dltype, "data": bytes(p.data)})))
    assert again["data"] == bytes(p.data)


@pytest.mark.parametrize("proto,layers", [("tcp", ["eth", "ip", "tcp"]), ("udp", ["eth", "ip", "udp"]), ("icmp", ["eth", "ip", "icmp"]), ("icmp6", ["eth", "ip6", "icmp6"]), ("arp", ["eth", "arp"])])
def test_made_packets_have_no_errors(proto, layers):
    p = edit.make(proto, b"" if proto == "arp" else b"hello")
    assert edit.names_of(p) == layers
    assert not any(u.error for u in dissect_bytes(bytes(p.data), p.dltype))


def test_a_changed_byte_is_a_checksum_error():
    p = edit.make("tcp", b"hello")
    p.data[-1] ^= 1
    assert any(u.error & CKSUM for u in dissect_bytes(bytes(p.data), p.dltype))
    p.fix_csums()
    assert not any(u.error for u in dissect_bytes(bytes(p.data), p.dltype))


def test_tunnels_and_tags_undo():
    p = edit.make("tcp", b"hello")
    was = bytes(p.data)
    edit.gre_encap(p, bytes(4), bytes(4), nvgre=True, vsid=77)
    assert edit.names_of(p)[:3] == ["eth", "ip", "nvgre"]
    assert edit.gre_decap(p, nvgre=True) and bytes(p.data) == was
    assert not edit.gre_decap(p) and bytes(p.data) == was
    p.vlan_push(9)
    p.mpls_push(20)
    p.mpls_push(30)
    assert [p.mpls_pop(), p.mpls_pop(), p.mpls_pop()] == [30, 20, None]
    assert p.vlan_pop() and not p.vlan_pop() and bytes(p.data) == was


def test_tcp_session_carries_its_text():
    from collections import defaultdict

    sent = defaultdict(bytes)
    for p in edit.tcp_session(b"q" * 27, b"a" * 28262):
        body = p.find("tcp")
        sent[bytes(p.get("tcp.sport"))] += bytes(p.data[body.poff : body.toff])
    assert sorted(map(len, sent.values())) == [27, 28262]


@pytest.mark.parametrize("text", ["tcp and", "(tcp", "tcp.nosuchfield == 1", "1 +"])
def test_malformed_predicates_raise(text):
    with pytest.raises((PmlError, KeyError)):
        pml.predicate(text)


def test_predicates_over_made_packets(spark):
    from wirelake.functions.dissect import with_pdus

    made = [edit.make("tcp", b"GET /", {"tcp.dport": 80}), edit.make("udp", b"q", {"udp.dport": 53}), edit.make("arp")]
    rows = with_pdus(edit.packet_rows(spark, made))
    for text, want in (("tcp", [1]), ("not (tcp)", [2, 3]), ("ip.daddr =~ 10.0.0.2/32", [1, 2]), ("udp.dport == 53 or arp", [2, 3]), ("tcp and tcp.payload =~ `G.T`", [1])):
        assert sorted(r.pkt_no for r in order.keep(rows, pml.predicate(text)).collect()) == want, text


def test_programs_print_and_drop(spark):
    rows = edit.packet_rows(spark, [edit.make("tcp"), edit.make("udp"), edit.make("tcp")])
    out = pml.run(rows, 'int n; ?- tcp -? { n = n + 1; } ?- udp -? { drop; } END { print "tcp=", n; }').collect()
    assert sorted(r.pkt_no for r in out if r.printed is None) == [1, 3]
    assert [r.printed.strip() for r in out if r.printed is not None] == ["tcp=2"]

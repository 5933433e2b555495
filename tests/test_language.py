"""The pattern language on single packets: references, tags, offsets, ticks and the standard library."""

import random

import pytest

from wirelake.functions.dissect import with_pdus
from wirelake.operators import edit, order
from wirelake.plans import pml
from wirelake.plans.pml.interpret import Machine
from wirelake.plans.pml.parse import PmlError, parse
from wirelake.schema import EMPTY_TAGS, PRID


def row_of(p, **tags):
    return EMPTY_TAGS | {"pkt_no": 1, "src_id": 0, "dltype": p.dltype, "data": bytes(p.data)} | tags


def ran(text, p=None, **tags):
    """What a program prints and sends for one packet."""
    m = Machine(parse(text))
    m.entry("BEGIN")
    m.feed(row_of(p if p is not None else edit.make("tcp", b"hello"), **tags))
    m.entry("END")
    return m.text, [edit.Packet(r["data"], r["dltype"]) for r in m.out], m.out


def said(text, p=None, **tags):
    return ran(text, p, **tags)[0]


def test_a_reference_writes_through():
    text, sent, _ = ran('str buf[4] = "abcd"; str ref; { &ref = buf[1,2]; ref = "XY"; print buf; &ref = tcp.payload; ref[1,3] = "EEE"; print ref; print str_addr(ref), " ", str_ispkt(ref), " ", str_len(ref); }')
    assert text == ["aXYd", "hEEEo", "54 1 5"]
    assert bytes(sent[0].data[54:]) == b"hEEEo"


def test_functions_take_references():
    assert said('void put(str s, int v) { s[0,2] = v; } int len(str s) { return str_len(s); } str b[4]; { put(b, 0x4142); print b[0,2], len(b), len(tcp.payload); }') == ["AB45"]


def test_made_references_and_null():
    assert said('str r; { print str_isnull(r); &r = str_mkref(1, 0, 54, 5); print r, str_seg(r); }') == ["1", "hello0"]
    with pytest.raises(IndexError):
        said("{ print str_mkref(1, 0, 54, 50); }")


def test_tags_by_type():
    text, _, out = ran(
        "{ print meta_has(0, 5); meta_add(0, 5); print meta_has(0, 5), meta_rd32(0, 5, 8); meta_wr32(0, 5, 8, 77); print meta_rd8(0, 5, 11), meta_rd16(0, 5, 10), meta_get_flowid(0);"
        " meta_add_info(0, 2); meta_wr16(0, 128, 2, 9); meta_wr8(0, 128, 4, 200); print meta_rd16(0, 128, 2), meta_rd8(0, 128, 4); meta_rem(0, 1); print meta_has(0, 1); }", ts_sec=5, ts_nsec=1,
    )
    assert text == ["0", "10", "777777", "9200", "0"]
    assert (out[0]["flow_id"], out[0]["ts_sec"], out[0]["ts_nsec"]) == (77, None, None)
    assert out[0]["appinfo"] == [(128, 9, b"\xc8" + bytes(7))]
    for bad in ("meta_wr8(0, 5, 1, 1);", "meta_rd32(0, 5, 9);", "meta_add(0, 5);"):
        with pytest.raises((IndexError, PmlError)):
            ran("{ " + bad + " }", flow_id=1)


def test_offsets_and_link_type():
    assert said("{ print pkt_get_off(0, @tcp, 0, 0), pkt_get_off(0, @ip, 0, 1); pkt_adj_off(0, @tcp, 0, 0, -2); print pkt_get_off(0, @tcp, 0, 0); }") == ["3434", "32"]
    _, sent, out = ran("{ pdu_delete(eth); fix_dltype(0); }")
    assert out[0]["dltype"] == PRID["ip"] and edit.names_of(sent[0]) == ["ip", "tcp"]


def test_inserted_and_cut_bytes_move_units():
    text, sent, _ = ran('{ pkt_ins_d(0, str_addr(tcp.payload), 3); print str_addr(ip), str_len(tcp.payload); pkt_cut_u(tcp.payload[0, 4]); print tcp.payload; }')
    assert text == ["145", "o"]
    assert bytes(sent[0].data[54:]) == b"DDDo"


def test_ticks_follow_the_packets_times():
    m = Machine(parse("int t; TICK { t = t + 1; } { print t; }"))
    for at in (10.0, 10.2, 10.2, 13.0):
        row = row_of(edit.make("udp"), ts_sec=int(at), ts_nsec=int(round(at % 1 * 1e9)))
        assert m.tick_until(row["ts_sec"] + row["ts_nsec"] / 1e9, 0.5)
        m.feed(row)
    assert m.text == ["0", "0", "0", "6"]


def test_the_budget_is_per_packet():
    m = Machine(parse("int i; { i = 0; while (i < 10) { i = i + 1; } }"), budget=200)
    for _ in range(50):
        m.feed(row_of(edit.make("udp")))
    endless = Machine(parse("{ while (1) { } }"), budget=2000)
    with pytest.raises(PmlError):
        endless.feed(row_of(edit.make("udp")))


def test_entry_points_run_in_turn():
    m = Machine(parse('BEGIN { print "a"; } BEGIN { print "b"; } END { print "c"; } END { print "d"; }'))
    m.entry("BEGIN")
    m.entry("END")
    assert m.text == ["a", "b", "c", "d"]


def test_formats():
    assert said('{ print %x% 255, " ", %o% 8, " ", %b% 5, " ", %u% -1, " ", %d% -1, " ", %+6d% 42, "|", %-6d% 42, "|"; }') == ["ff 10 101 4294967295 -1     42|42    |"]
    assert said("{ print %ip% ip.saddr, \" \", %eth% eth.src, \" \", %hex% ip.id; }") == ["10.0.0.1 02:00:00:00:00:01 0000"]


def test_lists_keep_their_order():
    assert said("{ pkt_copy(1, 0); pkt_copy(2, 0); $(1)ip.ttl = 1; $(2)ip.ttl = 2; pkt_enq(5, 1); pkt_enq(5, 2); print pkt_lempty(5), pkt_nlists(); pkt_deq(5, 3); print %hex% $(3)ip.ttl; pkt_pop(5, 3); print %hex% $(3)ip.ttl, pkt_lempty(5); drop; }") == ["0256", "01", "021"]


def test_loops_functions_and_recursion():
    assert said("int fact(int n) { if (n < 2) return 1; return n * fact(n - 1); } { print fact(6); i = 0; while (1) { i = i + 1; if (i == 3) continue; if (i > 5) break; } print i; }") == ["720", "6"]


STD = [
    ("fix", 'import "std"; { ip.ttl = 3; tcp.cksum = 0; fix(); print tcp.error, ip.error; }', ["00"]),
    ("host", "{ print host(10.0.0.1), host(10.0.0.9), host(02:00:00:00:00:02), host(fe80::1), host_pn(0, 10.0.0.2); }", ["10101"]),
    ("vlan", "{ print vlan_present(); vlan_push(7); print vlan_present(), %hex% eth.vlan0.vid, str_len(pkt); vlan_pop(); print vlan_present(), str_len(pkt); }", ["0", "1" + "00000007" + "63", "059"]),
    ("etype", "{ print etype_is_vlan(ETYPE_S_VLAN), etype_is_vlan(0x800), VXLAN_PORT, MAC_TYPE_MULTICAST; }", ["1047893"]),
    ("pop", "{ pdu_pop(); print ip.index, eth.index; }", ["10"]),
    ("room", "{ print pkt_headroom(), pkt_tailroom_pn(0), flowid(); }", ["00-1"]),
    ("grow", '{ print pkt_splice(tcp.payload[1,2], "LONGER"); print tcp.payload; }', ["0", "hLONGERlo"]),
    ("shrink", '{ pkt_splice(tcp.payload[1,3], ""); print tcp.payload, pkt_splice("abc", "d"); }', ["ho-1"]),
    ("make", "{ mk_udp_pn(1); mk_tcp_pn(2); mk_arp_pn(3); print $(1)udp.index, $(2)tcp.index, $(3)arp.index, $(2)tcp.error, $(1)ip.error; }", ["33200"]),
    ("gre", "{ gre_encap(); print gre.index, $(0,1)eth.index; gre_decap(); print gre.index, tcp.index; gre_decap(); print tcp.index; }", ["34", "03", "3"]),
    ("vxlan", "{ vxlan_encap(); udp.dport = VXLAN_PORT; pkt_parse(0); print vxlan.index; vxlan_decap(); print vxlan.index, tcp.index; }", ["4", "03"]),
    ("nvgre", "{ nvgre_encap(); print nvgre.index; nvgre_decap(); print tcp.index; }", ["3", "3"]),
    ("wraps", "{ udp_wrap(); ip_wrap(); eth_wrap(); print $(0,0)udp.index; }", ["3"]),
    ("mpls", "{ pdu_pop(); mpls_push(1000, 5, 9); mpls_push(2000, 1, 8); print mpls_nlabels(), \" \", mpls_get_label(0), \" \", mpls_get_label(1), \" \", mpls_get_tc(0), mpls_get_bos(0), mpls_get_bos(1), mpls_get_ttl(1); mpls_set_label(0, 77); mpls_set_tc(0, 2); mpls_set_ttl(0, 3); print mpls_get_label_pn(0, 0), mpls_get_tc(0), mpls_get_ttl(0); print mpls_pop() >> 12, \" \", mpls_pop() >> 12, \" \", mpls_pop(); print tcp.index; }", ["2 2000 1000 1019", "7723", "77 1000 0", "2"]),
]


@pytest.mark.parametrize("text, want", [x[1:] for x in STD], ids=[x[0] for x in STD])
def test_standard_library(text, want):
    assert said(text) == want


def rc4(key, n):
    s, j, out = list(range(256)), 0, []
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) % 256
        s[i], s[j] = s[j], s[i]
    i = j = 0
    for _ in range(n):
        i = (i + 1) % 256
        j = (j + s[i]) % 256
        s[i], s[j] = s[j], s[i]
        out.append(s[(s[i] + s[j]) % 256])
    return bytes(out)


def test_random_numbers_are_the_published_stream():
    assert rc4(b"Key", 5).hex() == "eb9f7781b7"
    want = rc4(b"Key", 13)
    assert said('{ rand_init("Key"); print %x% rand_byte(), " ", %x% rand_short(), " ", %x% rand_int(); }') == [f"{want[0]:x} {want[1:3].hex()} {want[3:7].hex()}"]
    for kind, first in (("ANY", want[7]), ("UNICAST", want[7] & 0xFC), ("LOC_UNICAST", want[7] & 0xFE | 2), ("MULTICAST", want[7] | 1)):
        _, sent, _ = ran('{ rand_init("Key"); rand_byte(); rand_short(); rand_int(); rand_mac(eth.src, MAC_TYPE_%s); }' % kind)
        assert bytes(sent[0].data[6:12]) == bytes([first]) + want[8:13]


def test_a_program_may_define_a_library_name():
    assert said('int host(str a) { return 9; } { print host(10.0.0.1); }') == ["9"]


def test_library_tests_as_columns(spark):
    made = [edit.make("tcp", b"GET /", {"tcp.dport": 80}), edit.make("udp", b"q", {"udp.dport": 53, "ip.saddr": bytes([9, 9, 9, 9])}), edit.make("arp"), edit.make("icmp6")]
    made[1].vlan_push(5)
    made[0].mpls_push(300, 2, 9)
    rows = with_pdus(edit.packet_rows(spark, made))
    for text, want in (
        ("host(10.0.0.1)", [1]), ("host(02:00:00:00:00:01)", [1, 2, 3, 4]), ("host(::)", [4]), ("vlan_present()", [2]), ("etype_is_vlan(ETYPE_C_VLAN) and arp", [3]),
        ("mpls and mpls_nlabels() == 1 and mpls_get_label(0) == 300 and mpls_get_ttl(0) == 9 and mpls_get_tc(0) == 2", [1]), ("flowid() == 0xffffffff", [1, 2, 3, 4]), ("udp.dport == 53 and not (host(1.2.3.4))", [2]),
    ):
        assert sorted(r.pkt_no for r in order.keep(rows, pml.predicate(text)).collect()) == want, text


def test_exact_tags_beside_nulls(spark):
    big = (1 << 60) + 1
    made = spark.createDataFrame([row_of(edit.make("udp"), pkt_no=k, flow_id=f) for k, f in ((1, big), (2, None), (3, -1))], edit.PACKET)
    for out in (pml.run(made, "{ send; }"), edit.edit(made, lambda p, row: None)):
        assert {r.pkt_no: r.flow_id for r in out.collect()} == {1: big, 2: None, 3: -1}


def test_streams_are_read_in_order(spark):
    rng = random.Random(3)
    rows = [row_of(edit.make("udp", bytes([65 + s, 97 + n])), pkt_no=n, src_id=s) for s in range(2) for n in range(3)]
    rng.shuffle(rows)
    out = pml.run(spark.createDataFrame(rows, edit.PACKET), "{ print udp.payload; drop; }").orderBy("sub_no").collect()
    assert [r.printed for r in out] == ["Aa", "Ab", "Ac", "Ba", "Bb", "Bc"]

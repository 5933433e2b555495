"""Every named field as data: where its bytes lie in a protocol data unit.

``whole`` is the unit itself; ``bytes BASE+OFF LEN`` and ``bits BASE+OFF BIT N`` start at an offset of
the unit (its start, or the place of an option, absent when the option is); ``var BASE+OFF END`` runs
to another offset; ``const``, ``mask`` and ``group`` hold no packet bytes. New protocols are added with
``register``.

LAYOUT and CONSTANTS are fixed values: the names are the query interface, the places are those of the
wire formats.
"""

from __future__ import annotations

from dataclasses import dataclass

from wirelake.schema import PRID

LAYOUT = """
pkt whole
pdu whole
eth whole
eth.dst bytes soff+0 6
eth.src bytes soff+6 6
eth.ethtype bytes etype+0 2
eth.vlan0 bytes vlan0+0 4
eth.vlan0.tpid bytes vlan0+0 2
eth.vlan0.pri bits vlan0+2 0 3
eth.vlan0.cfi bits vlan0+2 3 1
eth.vlan0.vid bits vlan0+2 4 12
eth.vlan1 bytes vlan1+0 4
eth.vlan1.tpid bytes vlan1+0 2
eth.vlan1.pri bits vlan1+2 0 3
eth.vlan1.cfi bits vlan1+2 3 1
eth.vlan1.vid bits vlan1+2 4 12
arp whole
arp.hwfmt bytes soff+0 2
arp.prfmt bytes soff+2 2
arp.hwlen bytes soff+4 1
arp.prlen bytes soff+5 1
arp.op bytes soff+6 2
arp.sndhwaddr bytes etharp+8 6
arp.sndpraddr bytes etharp+14 4
arp.trghwaddr bytes etharp+18 6
arp.trgpraddr bytes etharp+24 4
ip whole
ip.vers bits soff+0 0 4
ip.ihl bits soff+0 4 4
ip.diffsrv bits soff+1 0 6
ip.ecn bits soff+1 6 2
ip.len bytes soff+2 2
ip.id bytes soff+4 2
ip.rf bits soff+6 0 1
ip.df bits soff+6 1 1
ip.mf bits soff+6 2 1
ip.fragoff bits soff+6 3 13
ip.ttl bytes soff+8 1
ip.proto bytes soff+9 1
ip.cksum bytes soff+10 2
ip.saddr bytes soff+12 4
ip.daddr bytes soff+16 4
ip.opt var opt+0 poff
ip.addr group
ip.addr.broadcast const
ip.addr.localhost const
ip.addr.any const
ip.addr.localnet mask
ip6 whole
ip6.vers bits soff+0 0 4
ip6.class bits soff+0 4 8
ip6.flowid bits soff+0 12 20
ip6.len bytes soff+4 2
ip6.nxthdr bytes soff+6 1
ip6.hoplim bytes soff+7 1
ip6.saddr bytes soff+8 16
ip6.daddr bytes soff+24 16
ip6.xnxthdr bytes nxthdr+0 1
ip6.exth var soff+40 poff
icmp whole
icmp.type bytes soff+0 1
icmp.code bytes soff+1 1
icmp.cksum bytes soff+2 2
icmp.id bytes query+0 2
icmp.seq bytes query+2 2
icmp.mtu_resv bytes mtu+0 2
icmp.mtu bytes mtu+2 2
icmp.ptr bytes pptr+0 1
icmp.ptr_resv bytes pptr+1 3
icmp.ots bytes ts+0 4
icmp.rts bytes ts+4 4
icmp.tts bytes ts+8 4
icmp.gw bytes gw+0 4
icmp.resv bytes reserved+0 4
icmp6 whole
icmp6.echo bytes echo+0 4
icmp6.echo.id bytes echo+0 2
icmp6.echo.seq bytes echo+2 2
icmp6.rsol bytes rsol+0 4
icmp6.rsol.resv bytes rsol+0 4
icmp6.rsol.opts var ndpopt+0 poff
icmp6.radv bytes radv+0 12
icmp6.radv.hoplim bytes radv+0 1
icmp6.radv.mcfg bits radv+1 0 1
icmp6.radv.ocfg bits radv+1 1 1
icmp6.radv.resv bits radv+1 2 6
icmp6.radv.tlife bytes radv+2 2
icmp6.radv.treach bytes radv+4 4
icmp6.radv.tretry bytes radv+8 4
icmp6.radv.opts var ndpopt+0 poff
icmp6.neigh bytes neigh+0 20
icmp6.neigh.rtr bits neigh+0 0 1
icmp6.neigh.sol bits neigh+0 1 1
icmp6.neigh.ovd bits neigh+0 2 1
icmp6.neigh.resv bits neigh+0 3 29
icmp6.neigh.ip6a bytes neigh+4 16
icmp6.neigh.opts var ndpopt+0 poff
icmp6.nrdr bytes redir+0 36
icmp6.nrdr.tgtaddr bytes redir+4 16
icmp6.nrdr.dstaddr bytes redir+20 16
icmp6.nrdr.opts var ndpopt+0 poff
icmp6.srclla var srclla+0 srclla_eoff
icmp6.srclla.type bytes srclla+0 1
icmp6.srclla.len bytes srclla+1 1
icmp6.srclla.addr var srclla+2 srclla_eoff
icmp6.tgtlla var tgtlla+0 tgtlla_eoff
icmp6.tgtlla.type bytes tgtlla+0 1
icmp6.tgtlla.len bytes tgtlla+1 1
icmp6.tgtlla.addr var tgtlla+2 tgtlla_eoff
icmp6.pfxinfo bytes pfxinfo+0 32
icmp6.pfxinfo.type bytes pfxinfo+0 1
icmp6.pfxinfo.len bytes pfxinfo+1 1
icmp6.pfxinfo.pfxlen bytes pfxinfo+2 1
icmp6.pfxinfo.onlink bits pfxinfo+3 0 1
icmp6.pfxinfo.auto bits pfxinfo+3 1 1
icmp6.pfxinfo.resv bits pfxinfo+3 2 6
icmp6.pfxinfo.vlife bytes pfxinfo+4 4
icmp6.pfxinfo.plife bytes pfxinfo+8 4
icmp6.pfxinfo.resv2 bytes pfxinfo+12 4
icmp6.pfxinfo.pfx bytes pfxinfo+16 16
icmp6.rdrhdr var rdrhdr+0 rdrhdr_eoff
icmp6.rdrhdr.type bytes rdrhdr+0 1
icmp6.rdrhdr.len bytes rdrhdr+1 1
icmp6.rdrhdr.resv bytes rdrhdr+2 6
icmp6.rdrhdr.opkt var rdrhdr+8 rdrhdr_eoff
icmp6.omtu bytes mtu+0 8
icmp6.omtu.type bytes mtu+0 1
icmp6.omtu.len bytes mtu+1 1
icmp6.omtu.resv bytes mtu+2 2
icmp6.omtu.mtu bytes mtu+4 4
icmp6.radvivl bytes radvivl+0 8
icmp6.radvivl.type bytes radvivl+0 1
icmp6.radvivl.len bytes radvivl+1 1
icmp6.radvivl.resv bytes radvivl+2 2
icmp6.radvivl.ival bytes radvivl+4 4
icmp6.agtinfo bytes agtinfo+0 8
icmp6.agtinfo.type bytes agtinfo+0 1
icmp6.agtinfo.len bytes agtinfo+1 1
icmp6.agtinfo.resv bytes agtinfo+2 2
icmp6.agtinfo.pref bytes agtinfo+4 2
icmp6.agtinfo.life bytes agtinfo+6 2
icmp6.type bytes soff+0 1
icmp6.code bytes soff+1 1
icmp6.cksum bytes soff+2 2
icmp6.eresv bytes eresv+0 4
icmp6.pptr bytes pptr+0 4
udp whole
udp.sport bytes soff+0 2
udp.dport bytes soff+2 2
udp.len bytes soff+4 2
udp.cksum bytes soff+6 2
tcp whole
tcp.sport bytes soff+0 2
tcp.dport bytes soff+2 2
tcp.seqn bytes soff+4 4
tcp.ackn bytes soff+8 4
tcp.doff bits soff+12 0 4
tcp.resv bits soff+12 4 4
tcp.cwr bits soff+13 0 1
tcp.ece bits soff+13 1 1
tcp.urg bits soff+13 2 1
tcp.ack bits soff+13 3 1
tcp.psh bits soff+13 4 1
tcp.rst bits soff+13 5 1
tcp.syn bits soff+13 6 1
tcp.fin bits soff+13 7 1
tcp.win bytes soff+14 2
tcp.cksum bytes soff+16 2
tcp.urgp bytes soff+18 2
tcp.opt var opt+0 poff
tcp.mss bytes mss+0 4
tcp.mss.kind bytes mss+0 1
tcp.mss.len bytes mss+1 1
tcp.mss.mss bytes mss+2 2
tcp.wscale bytes wscale+0 4
tcp.wscale.kind bytes wscale+0 1
tcp.wscale.len bytes wscale+1 1
tcp.wscale.scale bytes wscale+2 1
tcp.sackok bytes sackok+0 2
tcp.sackok.kind bytes sackok+0 1
tcp.sackok.len bytes sackok+1 1
tcp.sack var sack+0 sack_end
tcp.sack.kind bytes sack+0 1
tcp.sack.len bytes sack+1 1
tcp.sack.blocks var sack+2 sack_end
tcp.ts bytes tstamp+0 10
tcp.ts.kind bytes tstamp+0 1
tcp.ts.len bytes tstamp+1 1
tcp.ts.val bytes tstamp+2 4
tcp.ts.echo bytes tstamp+6 4
tcp.md5 bytes md5+0 18
tcp.md5.kind bytes md5+0 1
tcp.md5.len bytes md5+1 1
tcp.md5.sig bytes md5+2 16
gre whole
gre.c_flag bits soff+0 0 1
gre.r_flag bits soff+0 1 1
gre.k_flag bits soff+0 2 1
gre.s_flag bits soff+0 3 1
gre.vers bits soff+1 5 3
gre.proto bytes soff+2 2
gre.cksum bytes cksum+0 2
gre.key bytes key+0 4
gre.seq bytes seq+0 4
nvgre whole
nvgre.c_flag bits soff+0 0 1
nvgre.r_flag bits soff+0 1 1
nvgre.k_flag bits soff+0 2 1
nvgre.s_flag bits soff+0 3 1
nvgre.vers bits soff+1 5 3
nvgre.proto bytes soff+2 2
nvgre.vsid bytes soff+4 3
nvgre.flowid bytes soff+7 1
vxlan whole
vxlan.vni_flag bits soff+0 4 1
vxlan.vsid bytes soff+4 3
mpls whole
mpls.label bits soff+0 0 20
mpls.tc bits soff+2 4 3
mpls.bos bits soff+2 7 1
mpls.ttl bytes soff+3 1
mpls.mpls1 bytes lbl1+0 4
mpls.mpls1.label bits lbl1+0 0 20
mpls.mpls1.tc bits lbl1+2 4 3
mpls.mpls1.bos bits lbl1+2 7 1
mpls.mpls1.ttl bytes lbl1+3 1
mpls.mpls2 bytes lbl2+0 4
mpls.mpls2.label bits lbl2+0 0 20
mpls.mpls2.tc bits lbl2+2 4 3
mpls.mpls2.bos bits lbl2+2 7 1
mpls.mpls2.ttl bytes lbl2+3 1
mpls.mpls3 bytes lbl3+0 4
mpls.mpls3.label bits lbl3+0 0 20
mpls.mpls3.tc bits lbl3+2 4 3
mpls.mpls3.bos bits lbl3+2 7 1
mpls.mpls3.ttl bytes lbl3+3 1
"""
CONSTANTS = {
    "ip.addr.broadcast": (bytes([255] * 4), None),
    "ip.addr.localhost": (bytes([127, 0, 0, 1]), None),
    "ip.addr.any": (bytes(4), None),
    "ip.addr.localnet": (bytes([127, 0, 0, 0]), bytes([255, 0, 0, 0])),
}
IMPLICIT = ("exists", "hlen", "plen", "tlen", "totlen", "error", "prid", "index", "header", "payload", "trailer", "pdu")


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    base: str = "soff"
    off: int = 0
    bit: int = 0
    size: int = 0
    end: str = ""

    @property
    def proto(self) -> str:
        return self.name.split(".")[0]

    @property
    def optional(self) -> bool:
        return self.base != "soff"


FIELDS: dict[str, Field] = {}


def register(layout: str, **prids: int) -> None:
    """Add fields (lines as in LAYOUT), and protocol numbers of new protocols."""
    PRID.update(prids)
    for line in layout.split("\n"):
        if not (words := line.split()):
            continue
        name, kind = words[:2]
        base, _, off = words[2].partition("+") if len(words) > 2 else ("soff", "", "0")
        if kind == "bytes":
            FIELDS[name] = Field(name, kind, base, int(off), size=int(words[3]))
        elif kind == "bits":
            FIELDS[name] = Field(name, kind, base, int(off), int(words[3]), int(words[4]))
        elif kind == "var":
            FIELDS[name] = Field(name, kind, base, int(off), end=words[3])
        else:
            FIELDS[name] = Field(name, kind)


register(LAYOUT)

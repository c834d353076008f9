"""Per-flow measures: what a packet adds, how that is merged, and how interim records combine it.

A measure is defined once: ``lift`` is what one packet brings, ``kind`` how two parts of a record merge (all kinds are
associative, so parts may come from map-side combining or from the state of a stream), ``combine`` how the records of a
long flow relate.  ``build`` makes the aggregate of a table from that; ``streaming.flows`` makes the state of a stream.

Every aggregation buffer is a fixed-width number, so Spark aggregates by hash
with whole-stage code; addresses of interfaces and digests are packed into
``bigint`` on the way in and unpacked on the way out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetflow.schemas import ACK, FIN, PSH, RST, SYN, TCP, URG

# How the records of one long flow combine a measure:
TOTAL = "total"  # grows over the whole flow
DELTA = "delta"  # of this record only
FIRST = "first"  # fixed by the flow's first packet
LATEST = "latest"  # newest non-null value so far


# How two parts of a record merge:
SUM = "sum"
OR = "or"  # bits
ANY = "any"
OPENING = "opening"  # what the flow's first packet brings
FIRST_OF = "first"  # of the record
LAST_OF = "last"  # of the record
LAST_SET = "last set"  # the last that is not null
OWN = "own"  # an aggregate of the caller's, which has no parts: tables only

# Packets that count, the others bring nothing:
FORWARD, BACKWARD, REPEATED = "direction = 1", "direction = 2", "_repeat"


@dataclass(frozen=True)
class Measure:
    """One output column of a flow record.

    ``lift`` is SQL over the packet's own columns; ``only`` limits it to some packets of the flow.  Order within the key is ``_pos``,
    ``_opens`` is true on the flow's first packet and ``_repeat`` on a retransmission.
    """

    needs: tuple[str, ...]
    lift: str | Callable[[], Column]
    kind: str
    combine: str
    default: object = None
    only: str | None = None

    def build(self) -> Column:
        """The aggregate over the packets of a record."""
        if self.kind == OWN:
            return F.expr(self.lift) if isinstance(self.lift, str) else self.lift()
        if self.kind == SUM and self.lift == ONE:
            return F.expr(f"count_if({self.only})" if self.only else "count(1)")
        lifted = f"IF({self.only}, {self.lift}, 0L)" if self.only else self.lift
        rule = {
            SUM: f"sum({lifted})",
            OR: f"bit_or({lifted})",
            ANY: f"bool_or({lifted})",
            OPENING: f"max(IF(_opens, {lifted}, NULL))",
            FIRST_OF: f"min_by({lifted}, _pos)",
            LAST_OF: f"max_by({lifted}, _pos)",
            LAST_SET: f"max_by({lifted}, IF(({lifted}) IS NOT NULL, _pos, NULL))",
        }
        return F.expr(rule[self.kind])


@dataclass(frozen=True)
class Packed:
    """An output column rebuilt from several numeric measures, as SQL text."""

    parts: tuple[str, ...]
    rule: str

    def unpack(self) -> Column:
        return F.expr(self.rule)


ONE = "1L"
_LENGTH = "CAST(ip_length AS BIGINT)"
_SQUARE = f"{_LENGTH} * {_LENGTH}"
_REPEAT_NEEDS = ("tcp_seq", "tcp_ack", "ip_plength", "tcp_flags")


def _flag_count(bit: int) -> Measure:
    return Measure(("tcp_flags",), f"IF(protocol = {TCP} AND tcp_flags & {bit} = {bit}, 1L, 0L)", SUM, TOTAL)


MEASURES: dict[str, Measure] = {
    "packet_total": Measure((), ONE, SUM, TOTAL),
    "octet_total": Measure(("ip_length",), _LENGTH, SUM, TOTAL),
    "octet_sum_squares": Measure(("ip_length",), _SQUARE, SUM, TOTAL),
    "packet_delta": Measure((), ONE, SUM, DELTA),
    "octet_delta": Measure(("ip_length",), _LENGTH, SUM, DELTA),
    "octet_delta_sum_squares": Measure(("ip_length",), _SQUARE, SUM, DELTA),
    "fin_count": _flag_count(FIN),
    "syn_count": _flag_count(SYN),
    "rst_count": _flag_count(RST),
    "psh_count": _flag_count(PSH),
    "ack_count": _flag_count(ACK),
    "urg_count": _flag_count(URG),
    "tcp_flags_or": Measure(("tcp_flags",), f"IF(protocol = {TCP}, tcp_flags, 0)", OR, DELTA),
    "retransmitted_packets": Measure(_REPEAT_NEEDS, ONE, SUM, DELTA, only=REPEATED),
    "retransmitted_octets": Measure((*_REPEAT_NEEDS, "ip_length"), _LENGTH, SUM, DELTA, only=REPEATED),
    "is_sampled": Measure(("is_sampled",), "is_sampled", ANY, TOTAL),
    "app_id": Measure(("app_id",), "nullif(app_id, 0)", LAST_SET, LATEST, 0),
}
for _name in ("l3_hlength", "l3_length", "l4_hlength"):
    for _side, _only in (("fwd", FORWARD), ("bwd", BACKWARD)):
        MEASURES[f"{_name}_{_side}"] = Measure((_name,), f"CAST({_name} AS BIGINT)", SUM, TOTAL, only=_only)

#: Header values kept from a flow's first packet: output name -> packet column.
FIRST_PACKET = {
    "first_tos": "tos",
    "first_ttl": "ttl",
    "first_ip_id": "ip_id",
    "first_ip_offset": "ip_offset",
    "first_ip_hlength": "ip_hlength",
    "first_ip_length": "ip_length",
    "first_tcp_window": "tcp_window",
    "first_tcp_urgent_ptr": "tcp_urgent_ptr",
    "first_icmp_type": "icmp_type",
    "first_icmp_code": "icmp_code",
    "first_flow_label": "flow_label",
    "first_next_header": "next_header",
}
#: Header values kept from a record's last packet.
LAST_PACKET = {
    "last_ip_plength": "ip_plength",
    "last_tcp_seq": "tcp_seq",
    "last_tcp_ack": "tcp_ack",
    "last_tcp_flags": "tcp_flags",
}
for _out, _in in FIRST_PACKET.items():
    MEASURES[_out] = Measure((_in,), _in, OPENING, FIRST)
for _out, _in in LAST_PACKET.items():
    MEASURES[_out] = Measure((_in,), _in, LAST_OF, DELTA)

# Addresses of interfaces travel as 48-bit numbers, digests as three numbers of 11, 11 and 10 hex digits.
PACKED: dict[str, Packed] = {}
_DIGEST_SPANS = ((1, 11), (12, 11), (23, 10))
for _out, _in in (("source_mac", "src_mac"), ("destination_mac", "dst_mac")):
    _number = f"CAST(conv(replace({_in}, ':', ''), 16, 10) AS BIGINT)"
    MEASURES[f"_{_out}"] = Measure((_in,), _number, OPENING, FIRST)
    _digits = f"lower(lpad(hex(_{_out}), 12, '0'))"
    PACKED[_out] = Packed((f"_{_out}",), f"regexp_replace({_digits}, '(..)(?!$)', '$1:')")
for _out, _pick in (("first", FIRST_OF), ("last", LAST_OF)):
    _parts = tuple(f"_{_out}_digest{i}" for i in range(3))
    for _part, (_start, _size) in zip(_parts, _DIGEST_SPANS):
        _number = f"CAST(conv(substr(packet_digest, {_start}, {_size}), 16, 10) AS BIGINT)"
        MEASURES[_part] = Measure(("packet_digest",), _number, _pick, DELTA)
    _text = ", ".join(f"lpad(hex({p}), {size}, '0')" for p, (_, size) in zip(_parts, _DIGEST_SPANS))
    PACKED[f"{_out}_packet_id"] = Packed(_parts, f"lower(concat({_text}))")

#: Everything a caller can ask for by name.
ALL = [name for name in MEASURES if not name.startswith("_")] + list(PACKED)


def resolve(measures: list[str] | None, columns: list[str]) -> tuple[list[str], list[str]]:
    """Numeric measures to aggregate and packed columns to rebuild, for ``columns`` of the input.

    Without a list, everything the input has the columns for.
    """
    available = set(columns)

    def usable(name: str) -> bool:
        parts = PACKED[name].parts if name in PACKED else (name,)
        return all(set(MEASURES[p].needs) <= available for p in parts)

    if measures is None:
        every = [name for name in MEASURES if not name.startswith("_")] + list(PACKED)
        wanted = [name for name in every if usable(name)]
    else:
        unknown = [name for name in measures if name not in MEASURES and name not in PACKED]
        missing = [name for name in measures if name not in unknown and not usable(name)]
        if unknown or missing:
            raise ValueError(f"unknown measures {unknown}, measures without input columns {missing}")
        wanted = list(measures)
    packed = [name for name in wanted if name in PACKED]
    plain = [name for name in wanted if name not in PACKED]
    for name in packed:
        plain.extend(part for part in PACKED[name].parts if part not in plain)
    return plain, packed

"""Information elements and export templates: flow records as named, typed columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetflow.operators import measures as M
from packetflow.operators.classify import application_id
from packetflow.operators.keys import flow_id_column, flow_key_indicator_column
from packetflow.schemas import ICMP, ICMP6, IE_DICTIONARY, IGMP

# Fixed value: enterprise number of the private elements.
ENTERPRISE = 26235


@dataclass(frozen=True)
class Export:
    """What an exporter knows besides the flow itself."""

    observation_point: int = 0
    observation_domain: int = 0
    exporter_ipv4: str = "0.0.0.0"
    exporter_ipv6: str = "::"
    exporter_port: int = 0
    collector_ipv4: str = "0.0.0.0"
    collector_ipv6: str = "::"
    collector_port: int = 4739
    export_interface: int = 0
    protocol_version: int = 10
    transport_protocol: int = 6
    init_ms: int = 0
    export_us: int = 0
    active_timeout_s: int = 5
    idle_timeout_s: int = 10


@dataclass(frozen=True)
class Element:
    """An information element: dictionary entry and value rule.

    The rule is SQL text over flow columns, in which ``{name}`` stands for an export
    setting, or a function of the settings.
    """

    ie: int
    name: str
    length: int
    coding: str
    rule: str | Callable[[Export], Column]
    needs: tuple[str, ...] = ()
    enterprise: int = 0
    spark_type: str = field(default="")

    def value(self, export: Export) -> Column:
        return F.expr(self.rule.format(**vars(export))) if isinstance(self.rule, str) else self.rule(export)

    @property
    def type(self) -> str:
        if self.spark_type:
            return self.spark_type
        if self.coding == "UINT":
            return {1: "smallint", 2: "int", 4: "bigint", 8: "bigint"}[self.length]
        if self.coding == "BYTES" and self.length == 1:
            return "smallint"
        return {"FLOAT": "double", "BOOL": "boolean"}.get(self.coding, "string")


V4, V6 = "ip_version = 4", "ip_version = 6"
ICMP_V4, ICMP_V6 = f"{V4} AND protocol = {ICMP}", f"{V6} AND protocol = {ICMP6}"
_TYPE_CODE = "first_icmp_type * 256 + first_icmp_code"
_MULTICAST = (
    f"CASE WHEN {V4} AND try_cast(split_part(dst_ip, '.', 1) AS INT) BETWEEN 224 AND 239 THEN 128"
    f" WHEN {V6} AND lower(dst_ip) RLIKE '^ff[0-9a-f]{{{{2}}}}:' THEN 128 ELSE 0 END"
)

U, B = "UINT", "BYTES"
_ICMP = ("first_icmp_type", "first_icmp_code")

# Number, name, length and coding of each element, with its value rule.
_STANDARD = [
    Element(1, "octetDeltaCount", 8, U, "octet_delta", ("octet_delta",)),
    Element(2, "packetDeltaCount", 8, U, "packet_delta", ("packet_delta",)),
    Element(4, "protocolIdentifier", 1, B, "protocol"),
    Element(5, "ipClassOfService", 1, B, "first_tos", ("first_tos",)),
    Element(7, "sourceTransportPort", 2, U, "src_port"),
    Element(8, "sourceIPv4Address", 4, B, f"IF({V4}, src_ip, NULL)"),
    Element(11, "destinationTransportPort", 2, U, "dst_port"),
    Element(12, "destinationIPv4Address", 4, B, f"IF({V4}, dst_ip, NULL)"),
    Element(21, "flowEndSysUpTime", 4, U, "unix_millis(flow_end) - {init_ms}"),
    Element(22, "flowStartSysUpTime", 4, U, "unix_millis(flow_start) - {init_ms}"),
    Element(27, "sourceIPv6Address", 16, B, f"IF({V6}, src_ip, NULL)"),
    Element(28, "destinationIPv6Address", 16, B, f"IF({V6}, dst_ip, NULL)"),
    Element(31, "flowLabelIPv6", 4, U, "first_flow_label & 1048575", ("first_flow_label",)),
    Element(32, "icmpTypeCodeIPv4", 2, U, f"IF({ICMP_V4}, {_TYPE_CODE}, NULL)", _ICMP),
    Element(33, "igmpType", 1, B, f"IF(protocol = {IGMP}, first_icmp_type, NULL)", ("first_icmp_type",)),
    Element(36, "flowActiveTimeout", 2, U, "{active_timeout_s}"),
    Element(37, "flowIdleTimeout", 2, U, "{idle_timeout_s}"),
    Element(54, "fragmentIdentification", 4, U, "first_ip_id", ("first_ip_id",)),
    Element(55, "postIpClassOfService", 1, B, "first_tos", ("first_tos",)),
    Element(56, "sourceMacAddress", 6, B, "source_mac", ("source_mac",)),
    Element(60, "ipVersion", 1, B, "ip_version"),
    Element(80, "destinationMacAddress", 6, B, "destination_mac", ("destination_mac",)),
    Element(85, "octetTotalCount", 8, U, "octet_total", ("octet_total",)),
    Element(86, "packetTotalCount", 8, U, "packet_total", ("packet_total",)),
    Element(88, "fragmentOffset", 2, U, "first_ip_offset & 8191", ("first_ip_offset",)),
    Element(95, "applicationId", 4, B, lambda e: application_id(F.col("app_id")), ("app_id",), spark_type="bigint"),
    Element(96, "applicationName", 32, B, "app_name", ("app_name",)),
    Element(130, "exporterIPv4Address", 4, B, "'{exporter_ipv4}'"),
    Element(131, "exporterIPv6Address", 16, B, "'{exporter_ipv6}'"),
    Element(132, "droppedOctetDeltaCount", 8, U, "retransmitted_octets", ("retransmitted_octets",)),
    Element(133, "droppedPacketDeltaCount", 8, U, "retransmitted_packets", ("retransmitted_packets",)),
    Element(136, "flowEndReason", 1, B, "end_reason"),
    Element(138, "observationPointId", 4, U, "{observation_point}"),
    Element(139, "icmpTypeCodeIPv6", 2, U, f"IF({ICMP_V6}, {_TYPE_CODE}, NULL)", _ICMP),
    Element(148, "flowID", 8, U, lambda e: flow_id_column(), spark_type="decimal(20,0)"),
    Element(149, "observationDomainId", 4, U, "{observation_domain}"),
    Element(152, "flowStartMilliseconds", 8, U, "unix_millis(flow_start)"),
    Element(153, "flowEndMilliseconds", 8, U, "unix_millis(flow_end)"),
    Element(154, "flowStartMicroseconds", 8, U, "unix_micros(flow_start)"),
    Element(155, "flowEndMicroseconds", 8, U, "unix_micros(flow_end)"),
    Element(156, "flowStartNanoseconds", 8, U, "unix_micros(flow_start) * 1000"),
    Element(157, "flowEndNanoseconds", 8, U, "unix_micros(flow_end) * 1000"),
    Element(158, "flowStartDeltaMicroseconds", 4, U, "{export_us} - unix_micros(flow_start)"),
    Element(159, "flowEndDeltaMicroseconds", 4, U, "{export_us} - unix_micros(flow_end)"),
    Element(160, "systemInitTimeMilliseconds", 8, U, "{init_ms}"),
    Element(161, "flowDurationMilliseconds", 4, U, "unix_millis(flow_end) - unix_millis(flow_start)"),
    Element(162, "flowDurationMicroseconds", 4, U, "unix_micros(flow_end) - unix_micros(flow_start)"),
    Element(173, "flowKeyIndicator", 8, U, lambda e: flow_key_indicator_column()),
    Element(176, "icmpTypeIPv4", 1, B, f"IF({ICMP_V4}, first_icmp_type, NULL)", _ICMP[:1]),
    Element(177, "icmpCodeIPv4", 1, B, f"IF({ICMP_V4}, first_icmp_code, NULL)", _ICMP[1:]),
    Element(178, "icmpTypeIPv6", 1, B, f"IF({ICMP_V6}, first_icmp_type, NULL)", _ICMP[:1]),
    Element(179, "icmpCodeIPv6", 1, B, f"IF({ICMP_V6}, first_icmp_code, NULL)", _ICMP[1:]),
    Element(184, "tcpSequenceNumber", 4, U, "last_tcp_seq", ("last_tcp_seq",)),
    Element(185, "tcpAcknowledgementNumber", 4, U, "last_tcp_ack", ("last_tcp_ack",)),
    Element(186, "tcpWindowSize", 2, U, "first_tcp_window", ("first_tcp_window",)),
    Element(187, "tcpUrgentPointer", 2, U, "first_tcp_urgent_ptr", ("first_tcp_urgent_ptr",)),
    Element(189, "ipHeaderLength", 1, B, "first_ip_hlength", ("first_ip_hlength",)),
    Element(190, "totalLengthIPv4", 2, U, f"IF({V4}, first_ip_length, NULL)", ("first_ip_length",)),
    Element(192, "ipTTL", 1, B, "first_ttl", ("first_ttl",)),
    Element(193, "nextHeaderIPv6", 1, B, f"IF({V6}, first_next_header, NULL)", ("first_next_header",)),
    Element(195, "ipDiffServCodePoint", 1, B, "shiftright(first_tos, 2)", ("first_tos",)),
    Element(196, "ipPrecedence", 1, B, "shiftright(first_tos, 5)", ("first_tos",)),
    Element(197, "fragmentFlags", 1, B, "shiftright(first_ip_offset, 8) & 224", ("first_ip_offset",)),
    Element(198, "octetDeltaSumOfSquares", 8, U, "octet_delta_sum_squares", ("octet_delta_sum_squares",)),
    Element(199, "octetTotalSumOfSquares", 8, U, "octet_sum_squares", ("octet_sum_squares",)),
    Element(204, "ipPayloadLength", 4, U, "last_ip_plength", ("last_ip_plength",)),
    Element(206, "isMulticast", 1, B, _MULTICAST),
    Element(207, "ipv4IHL", 1, B, f"IF({V4}, first_ip_hlength div 4, NULL)", ("first_ip_hlength",)),
    Element(211, "collectorIPv4Address", 4, U, "'{collector_ipv4}'", spark_type="string"),
    Element(212, "collectorIPv6Address", 16, U, "'{collector_ipv6}'", spark_type="string"),
    Element(213, "exportInterface", 1, B, "{export_interface}"),
    Element(214, "exportProtocolVersion", 1, U, "{protocol_version}"),
    Element(215, "exportTransportProtocol", 1, U, "{transport_protocol}"),
    Element(216, "collectorTransportPort", 2, U, "{collector_port}"),
    Element(217, "exporterTransportPort", 2, U, "{exporter_port}"),
    Element(218, "tcpSynTotalCount", 8, U, "syn_count", ("syn_count",)),
    Element(219, "tcpFinTotalCount", 8, U, "fin_count", ("fin_count",)),
    Element(220, "tcpRstTotalCount", 8, U, "rst_count", ("rst_count",)),
    Element(221, "tcpPshTotalCount", 8, U, "psh_count", ("psh_count",)),
    Element(222, "tcpAckTotalCount", 8, U, "ack_count", ("ack_count",)),
    Element(223, "tcpUrgTotalCount", 8, U, "urg_count", ("urg_count",)),
    Element(224, "ipTotalLength", 8, U, "first_ip_length", ("first_ip_length",)),
    Element(375, "originalFlowsPresent", 8, U, "original_present"),
    Element(376, "originalFlowsInitiated", 8, U, "original_initiated", ("syn_count",)),
    Element(377, "originalFlowsCompleted", 8, U, "original_completed", ("fin_count",)),
    Element(378, "distinctCountOfSourceIPAddress", 8, U, "distinct_src"),
    Element(379, "distinctCountOfDestinationIPAddress", 8, U, "distinct_dst"),
    Element(380, "distinctCountOfSourceIPv4Address", 4, U, "distinct_src_v4"),
    Element(381, "distinctCountOfDestinationIPv4Address", 4, U, "distinct_dst_v4"),
    Element(382, "distinctCountOfSourceIPv6Address", 8, U, "distinct_src_v6"),
    Element(383, "distinctCountOfDestinationIPv6Address", 8, U, "distinct_dst_v6"),
    Element(240, "roundTripTimeNanoseconds", 8, U, "rtt_fwd + rtt_bwd", ("rtt_pairs",), ENTERPRISE),
    Element(241, "packetPairsTotalCount", 8, U, "rtt_pairs", ("rtt_pairs",), ENTERPRISE),
    Element(242, "firstPacketID", 16, B, "first_packet_id", ("first_packet_id",), ENTERPRISE),
    Element(243, "lastPacketID", 16, B, "last_packet_id", ("last_packet_id",), ENTERPRISE),
    Element(244, "flowStartAfterExport", 8, U, "unix_micros(start_after_export) * 1000", (), ENTERPRISE),
]

ELEMENTS: dict[tuple[int, int], Element] = {}
for _element in _STANDARD:
    ELEMENTS.setdefault((_element.enterprise, _element.ie), _element)

#: The default template: every element, in number order, private ones last.
DEFAULT_TEMPLATE: list[tuple[int, int]] = [(e.ie, e.enterprise) for e in _STANDARD]

#: Elements a template table may list.
MOST_FIELDS = 1000

#: Flow columns that are not aggregated by ``build_flows`` itself.
_JOINED = {"app_name", "rtt_pairs"}


def find_element(ie: int, enterprise: int = 0) -> Element:
    try:
        return ELEMENTS[(enterprise, ie)]
    except KeyError:
        raise ValueError(f"unknown information element {ie} of enterprise {enterprise}") from None


def register_element(
    ie: int,
    name: str,
    type: str,
    measure: str | Callable[[], Column] | None,
    projection: str | Callable[[Export], Column] | None = None,
    *,
    needs: tuple[str, ...] = (),
    combine: str = M.DELTA,
    enterprise: int = 0,
    length: int = 8,
    coding: str = "UINT",
) -> Element:
    """Add an element: how packets aggregate into it, and how it is exported.

    ``measure`` is an aggregate over packet columns (``needs``), stored in the flow
    column ``name``; without one the projection uses existing flow columns.
    """
    if (enterprise, ie) in ELEMENTS:
        raise ValueError(f"element {ie} of enterprise {enterprise} exists already")
    if measure is not None:
        if name in M.MEASURES:
            raise ValueError(f"measure {name} exists already")
        M.MEASURES[name] = M.Measure(tuple(needs), measure, M.OWN, combine)
    element = Element(
        ie, name, length, coding, projection or name, (name,) if measure is not None else (), enterprise, type
    )
    ELEMENTS[(enterprise, ie)] = element
    return element


def unregister_element(ie: int, enterprise: int = 0) -> None:
    element = ELEMENTS.pop((enterprise, ie), None)
    if element is not None:
        M.MEASURES.pop(element.name, None)


def template_elements(template) -> list[Element]:
    """Elements of a template: (ie, enterprise) pairs, plain numbers, or a template table."""
    if isinstance(template, DataFrame):
        rows = template.orderBy("position").limit(MOST_FIELDS + 1).collect()
        if len(rows) > MOST_FIELDS:
            raise ValueError(f"a template of more than {MOST_FIELDS} elements")
        template = [(r["ie"], r["enterprise"]) for r in rows]
    pairs = [(item, 0) if isinstance(item, int) else (item[0], item[1] if len(item) > 1 else 0) for item in template]
    return [find_element(ie, enterprise or 0) for ie, enterprise in pairs]


def template_measures(template=DEFAULT_TEMPLATE) -> list[str]:
    """Measures a template needs: pass them to ``build_flows`` so nothing else is aggregated."""
    out: list[str] = []
    for element in template_elements(template):
        out.extend(n for n in element.needs if n not in out and n not in _JOINED)
    return out


def project_template(flows: DataFrame, template=DEFAULT_TEMPLATE, export: Export = Export()) -> DataFrame:
    """Flow records as the template's columns.  Values that a flow table lacks are null."""
    have = set(flows.columns)
    columns = []
    for element in template_elements(template):
        present = set(element.needs) - {"syn_count", "fin_count"} <= have
        value = element.value(export) if present else F.lit(None)
        columns.append(value.cast(element.type).alias(element.name))
    return flows.select(*columns)


def project_v9(flows: DataFrame, template=DEFAULT_TEMPLATE, export: Export = Export(protocol_version=9)) -> DataFrame:
    """The template without enterprise elements."""
    plain = [(e.ie, 0) for e in template_elements(template) if e.enterprise == 0]
    return project_template(flows, plain, export)


def project_v5(flows: DataFrame, export: Export = Export(protocol_version=5)) -> DataFrame:
    """The fixed 20 columns of version 5; counts keep their low 32 bits, unsupported columns are 0.

    Every flow is a record; the addresses of an IPv6 flow do not fit into the format and are 0.0.0.0.
    """
    narrow = F.lit(2**32)
    zero = F.lit(0)
    flags = F.col("tcp_flags_or") if "tcp_flags_or" in flows.columns else zero

    def count(name: str) -> Column:
        return F.pmod(F.col(name), narrow).cast("bigint")

    def address(name: str) -> Column:
        return F.when(F.col("ip_version") == 4, F.col(name)).otherwise(F.lit("0.0.0.0"))

    return flows.select(
        address("src_ip").alias("sourceAddress"),
        address("dst_ip").alias("destinationAddress"),
        F.lit("0.0.0.0").alias("nextHop"),
        zero.alias("inputInterface"),
        zero.alias("outputInterface"),
        count("packet_delta").alias("packetCount"),
        count("octet_delta").alias("octetCount"),
        (F.unix_millis("flow_start") - export.init_ms).alias("startSystemUpTime"),
        (F.unix_millis("flow_end") - export.init_ms).alias("endSystemUpTime"),
        F.col("src_port").alias("sourcePort"),
        F.col("dst_port").alias("destinationPort"),
        zero.alias("padding1"),
        flags.cast("smallint").alias("tcpFlags"),
        F.col("protocol").cast("smallint").alias("protocolType"),
        F.col("first_tos").cast("smallint").alias("typeOfService"),
        zero.alias("sourceAs"),
        zero.alias("destinationAs"),
        zero.alias("sourceMask"),
        zero.alias("destinationMask"),
        zero.alias("padding2"),
    )


def observation_ids(flows: DataFrame, point: int, domain: int) -> DataFrame:
    return flows.withColumns(
        {"observationPointId": F.lit(point).cast("bigint"), "observationDomainId": F.lit(domain).cast("bigint")}
    )


# Abstract data types of the public element registry -> (length, coding).
REGISTRY_TYPES = {
    "unsigned8": (1, "UINT"),
    "unsigned16": (2, "UINT"),
    "unsigned32": (4, "UINT"),
    "unsigned64": (8, "UINT"),
    "signed8": (1, "INT"),
    "signed16": (2, "INT"),
    "signed32": (4, "INT"),
    "signed64": (8, "INT"),
    "float32": (4, "FLOAT"),
    "float64": (8, "FLOAT"),
    "boolean": (1, "BOOL"),
    "macAddress": (6, "BYTES"),
    "ipv4Address": (4, "BYTES"),
    "ipv6Address": (16, "BYTES"),
    "octetArray": (65535, "BYTES"),
    "string": (65535, "STRING"),
    "dateTimeSeconds": (4, "UINT"),
    "dateTimeMilliseconds": (8, "UINT"),
    "dateTimeMicroseconds": (8, "UINT"),
    "dateTimeNanoseconds": (8, "UINT"),
}


def ie_dictionary(spark: SparkSession, registry: str | None = None) -> DataFrame:
    """The dictionary as a table: elements with a value rule, then those of a registry file.

    ``registry`` is the public registry's CSV (``ElementID, Name, Abstract Data Type``).
    An element defined here comes first and wins.
    """
    own = spark.createDataFrame(
        [(e.enterprise, e.ie, e.length, e.coding, e.name) for e in ELEMENTS.values()], IE_DICTIONARY
    )
    if registry is None:
        return own
    types = spark.createDataFrame([(k, *v) for k, v in REGISTRY_TYPES.items()], "data_type string, length int, coding string")
    listed = (
        spark.read.option("header", "true").option("multiLine", "true").csv(registry)
        .where(F.col("ElementID").rlike("^[0-9]+$"))
        .select(F.col("ElementID").cast("int").alias("ie"), F.col("Name").alias("name"), F.col("Abstract Data Type").alias("data_type"))
        .join(F.broadcast(types), "data_type")
        .dropDuplicates(["ie"])
        .select(F.lit(0).alias("enterprise"), "ie", "length", "coding", "name")
    )
    return own.unionByName(listed.join(own.select("enterprise", "ie"), ["enterprise", "ie"], "left_anti"))

"""Packets derived from the ``events`` table: the input of every registered query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetflow.sources.packets import read_packets

# Limits that fit events spread over 30 days.
IDLE = "48 hours"
ACTIVE = "120 hours"
PAIR_TIMEOUT = "24 hours"
MICE_OCTETS = 500
FLUSH_AT = "2024-01-20 00:00:00"
TRIGGER = "1 day"

_PACKETS_SQL = """
WITH e AS (SELECT event_id, ts, user_id, event_type, value,
                  CAST(regexp_replace(props,'[^0-9]','') AS INT) AS k, user_id % 10 AS u10 FROM {events}),
b AS (SELECT *, CASE WHEN u10=9 THEN 6 ELSE 4 END AS ip_version,
  CASE event_type WHEN 'click' THEN 6 WHEN 'view' THEN 6 WHEN 'purchase' THEN 17 WHEN 'signup' THEN 17
       ELSE CASE WHEN u10=9 THEN 58 ELSE 1 END END AS protocol,
  CASE event_type WHEN 'click' THEN 80 WHEN 'view' THEN 81 WHEN 'purchase' THEN 5061 WHEN 'signup' THEN 53
       ELSE 1000+CAST(user_id AS INT) END AS server_port,
  CASE WHEN event_type='error' THEN 1000+CAST(user_id AS INT) ELSE 40000+CAST(user_id AS INT) END AS client_port,
  CASE WHEN u10=9 THEN concat('2001:db8::', CAST(user_id % 256 AS STRING))
       ELSE concat('10.0.', CAST(user_id % 8 AS STRING), '.', CAST(user_id % 250 AS STRING)) END AS client_ip,
  CASE WHEN u10=9 THEN '2001:db8:ffff::1' ELSE concat('192.168.0.', CAST(user_id % 5 AS STRING)) END AS server_ip,
  concat('02:00:00:00:00:', lower(lpad(hex(user_id % 256), 2, '0'))) AS client_mac,
  concat('02:00:00:00:01:', lower(lpad(hex(user_id % 5), 2, '0'))) AS server_mac,
  event_id % 2 AS rev FROM e)
SELECT event_id AS packet_id, ts, CASE WHEN user_id % 3 = 0 THEN 'eth1' ELSE 'eth0' END AS interface,
  CAST(1 + user_id % 4 AS INT) AS obs_point,
  CASE WHEN rev=0 THEN client_mac ELSE server_mac END AS src_mac, CASE WHEN rev=0 THEN server_mac ELSE client_mac END AS dst_mac,
  ip_version, protocol,
  CASE WHEN rev=0 THEN client_ip ELSE server_ip END AS src_ip,   CASE WHEN rev=0 THEN server_ip ELSE client_ip END AS dst_ip,
  CASE WHEN rev=0 THEN client_port ELSE server_port END AS src_port, CASE WHEN rev=0 THEN server_port ELSE client_port END AS dst_port,
  32 + k % 96 AS ttl, (k % 8) * 32 AS tos, CAST(event_id % 65536 AS INT) AS ip_id,
  CASE k % 4 WHEN 0 THEN 16384 WHEN 1 THEN 8192 WHEN 2 THEN k ELSE 0 END AS ip_offset,
  CASE WHEN ip_version=6 THEN 40 ELSE 20 + 4 * (k % 2) END AS ip_hlength,
  40 + CAST(floor(value*3) AS INT) AS ip_length,
  40 + CAST(floor(value*3) AS INT) - CASE WHEN ip_version=6 THEN 40 ELSE 20 + 4 * (k % 2) END AS ip_plength,
  CASE WHEN protocol=17 THEN k ELSE 0 END AS udp_length,
  CASE WHEN protocol<>6 THEN 0 WHEN k<5 THEN 17 WHEN k<15 THEN 2 WHEN k<20 THEN 20 WHEN k<50 THEN 24 ELSE 16 END AS tcp_flags,
  CAST(k % 4 AS BIGINT) AS tcp_seq, CAST(CAST(floor(k/4) AS INT) % 4 AS BIGINT) AS tcp_ack,
  CASE WHEN protocol=6 THEN 1024 + k * 64 ELSE 0 END AS tcp_window, CASE WHEN protocol=6 THEN k % 3 ELSE 0 END AS tcp_urgent_ptr,
  CASE WHEN protocol=6 THEN 16 + 4 * (k % 5) ELSE 0 END AS tcp_hlength,
  CASE WHEN event_type='signup' THEN k % 3 ELSE 0 END AS dns_id,
  0 AS dns_opcode, CASE WHEN event_type='signup' THEN 1 ELSE 0 END AS dns_rd,
  CASE WHEN event_type='signup' THEN CAST(rev AS INT) ELSE 0 END AS dns_qr,
  CASE WHEN protocol IN (1,58) THEN CASE WHEN rev=0 THEN CASE WHEN ip_version=6 THEN 128 ELSE 8 END
                                         ELSE CASE WHEN ip_version=6 THEN 129 ELSE 0 END END ELSE 0 END AS icmp_type,
  CASE WHEN protocol IN (1,58) THEN k % 3 ELSE 0 END AS icmp_code,
  CAST(CASE WHEN ip_version=6 THEN k * 1000 ELSE 0 END AS BIGINT) AS flow_label,
  CASE WHEN ip_version=6 THEN protocol ELSE 0 END AS next_header,
  CASE WHEN ip_version=6 THEN 40 ELSE 20 + 4 * (k % 2) END AS l3_hlength,
  40 + CAST(floor(value*3) AS INT) AS l3_length,
  CASE WHEN protocol=6 THEN 16 + 4 * (k % 5) ELSE 0 END AS l4_hlength,
  md5(CAST(event_id AS STRING)) AS packet_digest,
  k % 7 = 0 AS is_sampled,
  CASE WHEN k % 3 = 0 THEN 0 ELSE CASE event_type WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 ELSE 0 END END AS app_id,
  concat('u', CAST(user_id % 50 AS STRING), CASE WHEN user_id % 3 = 0 THEN '.cdn.example.net' ELSE '.example.org' END) AS host
FROM b
"""


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One packet per event; unused columns are pruned down to the parquet scan."""
    events = read_packets(spark, f"{sf_dir}/events.parquet")
    return spark.sql(_PACKETS_SQL, events=events)


def sync_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clock exchanges: one per ``view`` event, in ns, with a drifting clock."""
    return samples_of(read_packets(spark, f"{sf_dir}/events.parquet"))


def samples_of(events: DataFrame) -> DataFrame:
    """The same of any table or stream of events."""
    events = events.where("event_type = 'view'")
    us = F.unix_micros("ts")
    k = F.regexp_replace("props", "[^0-9]", "").cast("bigint")
    return events.select(
        (1 + F.col("user_id") % 4).cast("int").alias("obs_point"),
        F.col("event_id").alias("seq"),
        (us * 1000 - 2_000_000 - k * 1000).alias("t1"),
        (us * 1000 - 1_000_000 - F.expr("(unix_micros(ts) - 1704067200000000) div 50") - k * 700).alias("t2"),
        (us * 1000).alias("t3"),
    )

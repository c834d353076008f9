"""Small packet tables typed by hand."""

import datetime as dt
import random

from packetflow.schemas import PACKETS

EPOCH = dt.datetime(2024, 1, 1)

DEFAULTS = {
    "interface": "eth0", "obs_point": 1, "src_mac": "02:00:00:00:00:01", "dst_mac": "02:00:00:00:00:02", "ip_version": 4,
    "src_ip": "10.0.0.1", "dst_ip": "192.168.0.1", "ttl": 64, "tos": 0, "protocol": 6, "ip_id": 0, "ip_offset": 0,
    "ip_hlength": 20, "ip_length": 100, "ip_plength": 80, "src_port": 40000, "dst_port": 80, "udp_length": 0, "tcp_seq": 0,
    "tcp_ack": 0, "tcp_flags": 16, "tcp_window": 0, "tcp_urgent_ptr": 0, "tcp_hlength": 20, "icmp_type": 0, "icmp_code": 0,
    "flow_label": 0, "next_header": 0, "dns_id": 0, "dns_opcode": 0, "dns_rd": 0, "dns_qr": 0, "l3_hlength": 20,
    "l3_length": 100, "l4_hlength": 20, "ip_bytes": None, "app_id": 0,
}


def at(seconds):
    """A time ``seconds`` after the fixture epoch."""
    return EPOCH + dt.timedelta(microseconds=round(seconds * 1_000_000))


def table(spark, rows):
    """Packets from dicts with ``t`` (seconds); missing columns get defaults, ids count from 1."""
    data = []
    for number, row in enumerate(rows, 1):
        full = {**DEFAULTS, **row}
        full.setdefault("packet_id", number)
        full["ts"] = at(full.pop("t"))
        data.append(tuple(full[f.name] for f in PACKETS.fields))
    return spark.createDataFrame(data, PACKETS)


def back(row):
    """The same packet in the other direction."""
    base = {**DEFAULTS, **row}
    return {**row, "src_ip": base["dst_ip"], "dst_ip": base["src_ip"], "src_port": base["dst_port"], "dst_port": base["src_port"]}


def random_rows(seed, count, span=600, hot=0.4):
    """Random two-way packets; one conversation holds ``hot`` of them, and half of those fall into one second."""
    rng = random.Random(seed)
    rows = []
    for _ in range(count):
        is_hot = rng.random() < hot
        client = 0 if is_hot else rng.randrange(1, 8)
        protocol = 6 if is_hot else rng.choice([6, 6, 17, 1])
        t = rng.uniform(100, 101) if is_hot and rng.random() < 0.5 else rng.uniform(0, span)
        row = {
            "t": round(t, 6), "src_ip": f"10.0.0.{client}", "dst_ip": "192.168.0.1", "protocol": protocol,
            "src_port": 53 if protocol == 17 and client % 2 else 40000 + client, "dst_port": 80, "ip_length": rng.randrange(40, 1500),
            "ip_plength": rng.choice([0, 10]), "tcp_flags": rng.choice([16, 16, 16, 2, 24, 17]) if protocol == 6 else 0,
            "tcp_seq": rng.randrange(3), "tcp_ack": rng.randrange(3), "icmp_type": rng.choice([0, 8]) if protocol == 1 else 0,
            "dns_id": rng.randrange(2), "dns_qr": rng.randrange(2),
        }
        rows.append(back(row) if rng.random() < 0.5 else row)
    return rows


def collect(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)

"""Round-trip pairs against a direct walk over the packets of each flow."""

import numpy as np
import pandas as pd
import pytest

from helpers import back, collect, random_rows, table
from packetflow.operators import flows, keys, rtt

FIELDS = (
    "ip_version", "protocol", "src_port", "dst_port", "k_ip1", "k_ip2", "k_port1", "k_port2", "k_dns", "flow_no", "direction",
    "_pos", "_t", "packet_id", "tcp_seq", "tcp_ack", "dns_id", "dns_opcode", "dns_rd", "dns_qr", "icmp_type",
)


def answers(probe, earlier):
    if probe["protocol"] == 6:
        return probe["tcp_seq"] == earlier["tcp_ack"]
    if probe["protocol"] == 17:
        if 53 not in (probe["src_port"], probe["dst_port"]):
            return False
        same = all(probe[n] == earlier[n] for n in ("dns_id", "dns_opcode", "dns_rd"))
        return same and earlier["dns_qr"] == 0 and probe["dns_qr"] == 1
    if probe["protocol"] == 1:
        return probe["icmp_type"] != 8 and probe["tcp_seq"] == earlier["tcp_seq"]
    return False


def walk(rows, timeout_us, consume):
    """Per flow: lists of earlier packets per direction, newest match first; a match may empty the list."""
    lists, out = {}, []
    for p in sorted(rows, key=lambda r: (r["_t"], r["packet_id"])):
        key = tuple(p[n] for n in ("ip_version", "protocol", "k_ip1", "k_ip2", "k_port1", "k_port2", "k_dns", "flow_no"))
        opposite = lists.setdefault((key, 3 - p["direction"]), [])
        for earlier in reversed(opposite):
            if answers(p, earlier):
                if p["_t"] - earlier["_t"] <= timeout_us:
                    out.append((p["packet_id"], earlier["packet_id"]))
                    if consume:
                        opposite.clear()
                break
        lists.setdefault((key, p["direction"]), []).append(p)
    return sorted(out)


@pytest.mark.parametrize("seed", [11, 12, 13])
@pytest.mark.parametrize("consume", [False, True])
@pytest.mark.parametrize("hot_rows", [10**6, 40])
def test_pairs_match_a_walk(spark, seed, consume, hot_rows):
    packets = table(spark, random_rows(seed, 400))
    split = flows.split_flows(keys.flow_key(packets, biflow=True), "60 seconds", hot_rows=hot_rows, chunk="7 seconds")
    assert ("_chunk" in split.columns) == (hot_rows == 40)
    rows = [r.asDict() for r in split.select(*FIELDS).collect()]
    got = sorted((r.packet_id, r.matched_id) for r in rtt.rtt_pairs(split, "8 seconds", consume=consume).collect())
    want = walk(rows, 8_000_000, consume)
    assert want and got == want


def test_timeout_edge_and_summary(spark):
    rows = [
        {"t": 0, "tcp_ack": 7}, back({"t": 1, "tcp_seq": 7, "tcp_ack": 9}), {"t": 1.5, "tcp_seq": 9, "tcp_ack": 1},
        back({"t": 3, "tcp_seq": 7, "tcp_ack": 2}),
    ]
    split = flows.split_flows(keys.flow_key(table(spark, rows), biflow=True), "10 seconds")
    pairs = rtt.rtt_pairs_tcp(split, "1 second")
    assert collect(pairs, "packet_id", "matched_id", "direction", "delay_us") == [(2, 1, 2, 1_000_000), (3, 2, 1, 500_000)]
    assert rtt.rtt_pairs_tcp(split, "999999 microseconds").count() == 1
    summary = rtt.rtt_summary(pairs)
    assert collect(summary, "rtt_fwd", "rtt_bwd", "rtt", "rtt_pairs") == [(5e8, 1e9, 1.5e9, 2)]


def test_interim_records_carry_running_means(spark):
    rows = [{"t": 0, "tcp_ack": 7}, back({"t": 1, "tcp_seq": 7}), {"t": 6, "tcp_ack": 8}, back({"t": 6.5, "tcp_seq": 8})]
    built = flows.build_flows(table(spark, rows), "10 seconds", active="5 seconds", biflow=True, measures=["packet_total"], pair_timeout="1 second")
    assert collect(built, "slice", "rtt_bwd", "rtt_pairs") == [(0, 1e9, 1), (1, 7.5e8, 2)]


def test_no_pair_list_is_formed(spark):
    """The plan has no join between packets: pairing is a window."""
    split = flows.split_flows(keys.flow_key(table(spark, random_rows(1, 20)), biflow=True), "60 seconds")
    plan = rtt.rtt_pairs(split, "1 second")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


@pytest.mark.parametrize("seed", range(20))
def test_chunk_functions_compose(seed):
    """Limits passed through chunk functions equal a walk in one piece."""
    rng = np.random.default_rng(seed)
    ends = np.sort(rng.choice(200, 60, replace=False)) + 1
    begins = np.array([rng.integers(max(0, e - rng.integers(1, 80)), e) for e in ends])
    walked, limit = [], -1
    for b, e in zip(begins, ends):
        walked.append(limit)
        limit = e if b > limit else limit
    pairs = pd.DataFrame({"k": 1, "_chunk": ends // 25, "_matched_pos": begins, "_pos": ends})
    steps = [rtt._limit_function(["k"])(part) for _, part in pairs.groupby("_chunk")]
    along = rtt._limits_along(["k"])(pd.concat(steps))
    for chunk, start in zip(along["_chunk"], along["_limit"]):
        assert start == walked[int(np.flatnonzero(pairs["_chunk"] == chunk)[0])]

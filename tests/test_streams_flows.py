"""Streams that reorder and join, and flow records in CSV files."""

import heapq
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import convert
from tessera.plans import registry
from tessera.sources import flows
from tessera.streaming import reorder


def by_hand(rows, wait, most):
    """(order, time) of one key by arrival: what leaves, in turn, with watermark and lateness, and what is left."""
    heap, newest, top, out = [], -math.inf, None, []

    def leave():
        nonlocal top
        t, o = heapq.heappop(heap)
        out.append((o, t, top, 0))
        top = t if top is None else max(top, t)

    for o, t in rows:
        if top is not None and t < top:
            out.append((o, t, top, top - t))
            continue
        heapq.heappush(heap, (t, o))
        newest = max(newest, t)
        while heap and (heap[0][0] <= newest - wait or (most is not None and len(heap) > most)):
            leave()
    left = len(out)
    while heap:
        leave()
    return out, left


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=40), st.integers(0, 12), st.one_of(st.none(), st.integers(0, 6)), st.lists(st.integers(1, 40), max_size=4))
def test_departures_equal_the_buffer(times, wait, most, cuts):
    want, left = by_hand(list(enumerate(times)), wait, most)
    us, turn, newest, got = np.zeros(0, np.int64), np.zeros(0, np.int64), None, []
    for a, b in zip([0, *sorted(cuts)], [*sorted(cuts), len(times)]):
        now = np.array(times[a:b], np.int64)
        us, turn = np.concatenate([us, now]), np.concatenate([turn, np.arange(a, a + len(now))])
        step = reorder.departures(us, np.concatenate([np.full(len(us) - len(now), -1), np.arange(len(now))]), wait, most, newest)
        go = np.flatnonzero(step < len(now))
        go = go[np.lexsort((go, us[go], step[go]))]
        got += turn[go].tolist()
        newest = max([*us.tolist(), *([] if newest is None else [newest])], default=None)
        us, turn = us[step >= len(now)], turn[step >= len(now)]
    assert got == [o for o, *_ in want[:left]]
    assert sorted(turn.tolist()) == sorted(o for o, *_ in want[left:])


@pytest.mark.parametrize("most", [None, 5])
def test_reordered_over_several_batches(spark, tmp_path, most):
    rng = random.Random(3)
    rows = [(rng.choice([1, 2, None]), i, 1_700_000_000 + i * 20 - rng.choice([0, 0, 30, 90, 400])) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, turn long, s long").select("k", "turn", F.timestamp_seconds("s").alias("time"), F.lit("x").alias("us"))
    for i in range(3):  # files of one batch each, by arrival
        df.filter(f"turn >= {i * 100} AND turn < {i * 100 + 100}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = defaultdict(dict)
    for r in reorder.reordered_all(stream, "k", "turn", 60_000_000, most).collect():
        got[r.k][r.place] = (r.turn, r.us, r.watermark, r.uncertainty)
    for k in (1, 2, None):
        want, _ = by_hand([(o, t * 1_000_000) for w, o, t in rows if w == k], 60_000_000, most)
        assert [got[k][i] for i in range(len(got[k]))] == want


def test_interval_join_over_several_batches(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "b"]), rng.randrange(4), 1_700_000_000 + i * 40 + rng.randrange(200)) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, kind string, k long, s long").select("id", "kind", "k", F.timestamp_seconds("s").alias("time"))
    for i in range(3):
        df.filter(f"id >= {i * 80} AND id < {i * 80 + 80}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    from tessera.streaming.events import all_available

    pairs = reorder.interval_joined(stream().filter("kind = 'a'"), stream().filter("kind = 'b'"), "k", "5 MINUTES", ("10 minutes", "10 minutes"))
    got = {(r.left_id, r.right_id) for r in all_available(pairs, "pairs").collect()}
    assert got == {(a[0], b[0]) for a in rows for b in rows if a[1] == "a" and b[1] == "b" and a[2] == b[2] and 0 <= a[3] - b[3] <= 300}


HEADER = "Dst Port,Protocol,Timestamp,Flow Duration,Tot Fwd Pkts,Tot Bwd Pkts,Label,Fwd Len,Fwd Len"


def test_headers_lines_and_quarantine(spark, tmp_path):
    one = ["﻿" + HEADER, "80,6,1/3/2018 8:05:01,5,1,0,\"a, b\",7,8", HEADER, "", "80,6,1/3/2018", "80,6,02/03/2018 08:05:02,-5,1,0,Benign,7,8,9"]
    (tmp_path / "a.csv").write_text("\r\n".join(one))
    good, bad = flows.cic_flows(spark, str(tmp_path / "a.csv"))
    row = good.collect()
    assert len(row) == 1 and (row[0].dst_port, row[0].label, row[0].duration, row[0].start_us, row[0].src) == (80.0, "a, b", 5e-6, 1_519_891_501_000_000, None)
    assert sorted(r._quarantine for r in bad.collect()) == ["not 9 cells"] * 2
    with pytest.raises(ValueError, match="no column for"):
        flows.argus_flows(spark, str(tmp_path / "a.csv"))
    (tmp_path / "b.csv").write_text(" Source Port , Protocol,Timestamp\n1,17,3/7/2017 8:55\n2,17,3/7/2017 10:55\n3,17,bad\n")
    good, _ = flows.cic_flows(spark, str(tmp_path / "b.csv"), offset_hours=-3)
    got = sorted((r.src_port, r.start_us, r.resolution_us, r.unread_time) for r in good.collect())
    assert got == [(1.0, 1_499_082_900_000_000, 60_000_000, False), (2.0, 1_499_090_100_000_000, 60_000_000, False), (3.0, None, 60_000_000, True)]
    ends = flows.with_entities(good, synthetic_internal=True).collect()
    assert len({x for r in ends for x in (r.initiator, r.responder)}) == 6 and all(r.synthetic and r.initiator_internal for r in ends)
    with pytest.raises(Exception, match="say whether they are internal"):
        flows.with_entities(good).collect()


def test_watermarks_follow_the_file(spark, tmp_path):
    for name, times in (("a", [5, 9, 7, 3]), ("b", [8, 2, 30, 29])):
        (tmp_path / f"{name}.csv").write_text("timestamp,protocol,label\n" + "".join(f"2024-01-01 00:00:{t:02d},6,{i}\n" for i, t in enumerate(times)))
    good, _ = flows.cic_flows(spark, str(tmp_path))
    got = {(r.file[-5], r.label): (r.watermark_us and r.watermark_us // 1_000_000 % 60, r.reorder_us // 1_000_000) for r in flows.watermarked(good).collect()}
    assert got == {("a", "0"): (None, 1), ("a", "1"): (5, 1), ("a", "2"): (9, 2), ("a", "3"): (9, 6), ("b", "0"): (None, 1), ("b", "1"): (8, 6), ("b", "2"): (8, 1), ("b", "3"): (30, 1)}


def test_port_evidence(spark):
    rng = random.Random(7)
    rows = [(s, d, i, rng.choice([20, 21, 22, 23, 80, 443, rng.randrange(30)])) for i in range(400) for s, d in [(rng.randrange(2), rng.choice(["x", "y"]))]]
    got = {r.i: (r.known, r.sequential and round(r.sequential, 9), r.random and round(r.random, 9)) for r in flows.port_evidence(spark.createDataFrame(rows, "s long, d string, i long, p long").repartition(4), "s", "d", "p", ["i"], ports=6).collect()}
    for s in (0, 1):
        for d in ("x", "y"):
            memory = []
            for _, _, i, p in (r for r in rows if r[:2] == (s, d)):
                memory = memory if p in memory else [*memory, p][-6:]
                near = sum(abs(a - b) == 1 for a, b in zip(memory, memory[1:]))
                share = near / (len(memory) - 1) if len(memory) >= 4 else None
                known, a, b = got[i]
                assert known == len(memory) and (a or 0) == pytest.approx(share or 0) and (b or 0) == pytest.approx(0 if share is None else len(memory) / 6 * (1 - share))


def test_addresses(spark):
    import ipaddress

    texts = ["10.1.2.3", " 10.1.2.3\t", "256.1.1.1", "::", "::1", "fe80::1", "2001:DB8::a:0:0", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1::2::3", "::ffff:192.168.1.9", "12345::", "", "x", "1:2:3:4:5:6:7::", "ff02::fb", ":1", "224.0.0.1", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    nets = ["10.0.0.0/8", "fe80::/10", "2001:db8::/32"]
    for r in df.select("t", convert.ipv6(F.col("t")).alias("six"), convert.in_networks(F.col("t"), nets).alias("inside"), convert.group_address(F.col("t")).alias("many")).collect():
        try:
            a = ipaddress.ip_address((r.t or "").strip())
        except ValueError:
            a = None
        assert r.six == (f"{int(a):032x}" if a is not None and a.version == 6 else None), r.t
        assert r.inside == (None if a is None else any(a.version == n.version and a in n for n in map(ipaddress.ip_network, nets))), r.t
        assert r.many == (a is not None and a.is_multicast), r.t


def test_port_evidence_query(spark, data):
    rows = registry.QUERIES["flow_port_evidence"](spark, data).collect()
    assert len(rows) and all(0 <= r.sequential <= 1 and 0 <= r.random <= 1 for r in rows if r.sequential is not None)

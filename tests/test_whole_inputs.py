"""Registered queries read all rows of their inputs."""

from bisect import bisect_right
from collections import Counter

from pyspark.sql import functions as F

from beamloom.operators import assembly, monitor
from beamloom.plans import queries
from beamloom.sources.telemetry import telemetry

SF = "/root/testdata/sf0.001"


def dense(cells):
    """(beam, chunk, present) of every chunk between a beam's first and last."""
    beams = {b: [c for x, c in cells if x == b] for b, _ in cells}
    return {(b, c, (b, c) in cells) for b, cs in beams.items() for c in range(min(cs), max(cs) + 1)}


def test_dense_chunks_of_all_samples(spark):
    rows = telemetry(spark, SF).select("beam_id", "ichunk", "packet_chunk").collect()
    got = queries.q52_dense_chunks(spark, SF).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == dense({(r.beam_id, r.ichunk) for r in rows})
    # packets from far ahead leave gaps
    jumps = {(r.beam_id, r.packet_chunk) for r in rows}
    far = telemetry(spark, SF).selectExpr("beam_id", "packet_chunk as ichunk")
    got = assembly.dense_chunks(far).collect()
    assert {tuple(r) for r in got} == dense(jumps) and not all(r.present for r in got)


def looked_up(probes, history):
    """(probe, start, n) with the last entry at or before each probe."""
    starts = sorted(history)
    last = [starts[i - 1] if (i := bisect_right(starts, p)) else None for p in probes]
    return Counter((p, t, history.get(t)) for p, t in zip(probes, last))


def test_asof_of_the_whole_history(spark):
    rows = telemetry(spark, SF).select("us", "sender").collect()
    hour = queries.PERIOD_US
    history = Counter(r.us // hour * hour for r in rows)
    got = queries.q32_rate_asof(spark, SF).collect()
    assert Counter(map(tuple, got)) == looked_up([r.us for r in rows], history)
    # one sender's history has natural gaps: older entries
    sender = Counter(r.sender for r in rows).most_common(1)[0][0]
    own = Counter(r.us // hour * hour for r in rows if r.sender == sender)
    entries = queries.rates(spark, SF).filter(F.col("sender") == sender)
    got = monitor.asof(telemetry(spark, SF).select("us"), entries, "us", "start_us", "n").collect()
    assert Counter(map(tuple, got)) == looked_up([r.us for r in rows], own)
    assert any(r.start_us is not None and r.us - r.start_us > hour for r in got)

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from beamloom.config import Grid, StreamConfig
from beamloom.operators import assembly, ring


def simulate(packets, align):
    """(active, hit) of each packet, packet by packet."""
    active, out = None, []
    for p in packets:
        if active is None:
            active = -(-p // align) * align if align else p
        if p >= active + 2:
            active += 1
        out.append((active, p in (active, active + 1)))
    return out


@pytest.mark.parametrize("align, ranges", [(0, None), (4, None), (0, 9), (4, 30)])
def test_strict_assembly(spark, align, ranges):
    rng = random.Random(align)
    rows, want = [], {}
    for beam in range(4):
        chunks = sorted(rng.randint(5, 25) for _ in range(80))
        chunks = [c + rng.choice([0, 0, 0, -3, 1, 60]) for c in chunks]
        for k, (c, v) in enumerate(zip(chunks, simulate(chunks, align))):
            rows.append((beam, beam * 1000 + k, k, c))
            want[beam * 1000 + k] = v
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "beam_id int, event_id long, arrival long, packet_chunk long")
    got = assembly.assemble_strict(df, align, ranges)
    assert {r.event_id: (r.active, r.hit) for r in got.collect()} == want
    assert assembly.assemble_strict(df.limit(0), align, ranges).collect() == []


@pytest.mark.parametrize("rogue", [0.0, 0.02, 0.4])
def test_one_beam_over_many_ranges(spark, monkeypatch, rogue):
    """Late, early and rogue packets; the wrong guesses are played again until every range begins where the last one ends."""
    rng, again = random.Random(7), []
    run = assembly._again
    monkeypatch.setattr(assembly, "_again", lambda rows, entries, verdicts: again.append(verdicts) or run(rows, entries, verdicts))
    chunks = [10**12 if rng.random() < rogue else max(0, i // 40 + rng.choice([0, 0, 0, 0, 1, -1, -5])) for i in range(6000)]
    df = spark.createDataFrame([(3, i, i // 3, c) for i, c in enumerate(chunks)], "beam_id int, event_id long, arrival long, packet_chunk long").repartition(5)
    got = {r.event_id: (r.active, r.hit) for r in assembly.assemble_strict(df, 0, 12).collect()}
    assert got == dict(enumerate(simulate(chunks, 0)))
    assert again.count(False) <= 12 and (rogue or again.count(False) <= 1)


@pytest.mark.parametrize("ranges", [None, 11])
def test_injected_chunks_move_the_window(spark, ranges):
    rng, rows, want, active = random.Random(8), [], {}, None
    for i in range(3000):
        p, put = max(0, i // 30 + rng.choice([0, 0, 1, -1, 50])), rng.random() < 0.01
        if active is None:
            active = p
        if put:
            active = p + 1
        elif p >= active + 2:
            active += 1
        rows.append((3, i, i, p, put))
        want[i] = (active, None if put else p in (active, active + 1))
    df = spark.createDataFrame(rows, "beam_id int, event_id long, arrival long, packet_chunk long, inject boolean").repartition(4)
    assert {r.event_id: (r.active, r.hit) for r in assembly.assemble_strict(df, 0, ranges).collect()} == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=60), st.integers(-5, 35))
def test_windows_from_which_a_range_leaves_the_same(chunks, active):
    chunks = np.array(chunks, np.int64)
    leave = assembly.window_path(chunks, active)[1]
    high = assembly.entered(chunks, leave)
    assert [assembly.window_path(chunks, a)[1] == leave for a in (active, high, high + 1)] == [True, True, False]


def telescope(n, capacities):
    """Residents of each level after n pushes, one push at a time: (index in units of the level, level)."""
    levels, counts = [[] for _ in capacities], 0
    def push(level, j):
        if level == len(capacities) - 1:
            levels[level].append(j)
            if len(levels[level]) > capacities[level]:
                levels[level].pop(0)
            return
        if len(levels[level]) == capacities[level]:
            a = levels[level].pop(0)
            levels[level].pop(0)
            push(level + 1, a // 2)
        levels[level].append(j)
    for j in range(n):
        push(0, j)
        counts += 1
    return levels


def test_ring_closed_form(spark):
    rng = random.Random(7)
    for _ in range(4):
        capacities = tuple(rng.randint(2, 6) for _ in range(rng.randint(1, 4)))
        cases = [(b, 10 * b, rng.randint(1, 90)) for b in range(25)]
        df = spark.createDataFrame(cases, "beam_id int, first_ichunk long, n long")
        got = {(r.beam_id, r.level, r.ichunk, r.binning) for r in ring.contents(df, capacities).collect()}
        want = {(b, lv, first + j * 2**lv, 2**lv) for b, first, n in cases for lv, items in enumerate(telescope(n, capacities)) for j in items}
        assert got == want
        assert ring.contiguity(ring.contents(df, capacities)).count() == 0
    with pytest.raises(ValueError):
        ring.contents(df, (1, 4))


def test_other_assembly(spark):
    df = spark.createDataFrame([(1, 0, 3, 1, 5.0), (1, 0, 9, 2, 7.0), (1, 0, 9, 3, 8.0)], "beam_id int, freq int, arrival int, event_id int, v double")
    assert assembly.last_write_wins(df, ["beam_id", "freq"], "v").collect()[0].v == 8.0
    chunks = spark.createDataFrame([(1, 3, "a"), (1, 5, "b")], "beam_id int, ichunk long, tag string")
    extra = spark.createDataFrame([(1, 5, "x"), (1, 6, "y")], "beam_id int, ichunk long, tag string")
    assert {(r.ichunk, r.tag) for r in assembly.inject_chunks(chunks, extra).collect()} == {(3, "a"), (5, "x"), (6, "y")}
    assert [(r.ichunk, r.present) for r in assembly.dense_chunks(chunks).orderBy("ichunk").collect()] == [(3, True), (4, False), (5, True)]
    ready = spark.createDataFrame([(1, 0, 1, True), (1, 1, 1, True), (1, 3, 1, True), (1, 4, 1, False)], "beam_id int, ichunk long, binning int, mask_ready boolean")
    assert [r.mergeable for r in ring.can_downsample(ready).orderBy("ichunk").collect()] == [True, False, False, False]


def test_configuration():
    g = Grid()
    assert (g.nt_coarse, g.nscales, g.ndata, g.rfi_mask_bytes(1024)) == (64, 65536, 16777216, 131072)
    assert g.slab_bytes() == 16777216 + 2 * 262144
    for bad in ({"nupfreq": 0}, {"nt_per_packet": 3}, {"counts_per_sample": 0}, {"nt_per_packet": 2048}):
        with pytest.raises(ValueError):
            Grid(**bad)
    for bad in ({"beam_ids": ()}, {"beam_ids": (1, 1)}, {"beam_ids": (70000,)}, {"beam_ids": (1,), "nt_align": 5}, {"beam_ids": (1,), "ring_capacity": 1}):
        with pytest.raises(ValueError):
            StreamConfig(**bad)
    assert StreamConfig((1,), telescoping=(4, 3, 2)).capacities == (12, 3, 2)

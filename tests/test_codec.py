import numpy as np
import pytest
from pyspark.sql import functions as F

from beamloom.operators import codec, downsample


def samples(spark, seed, tiles=6, size=32, shift=0.0, zero=0.2):
    rng = np.random.default_rng(seed)
    rows = []
    for t in range(tiles):
        for i in range(size):
            weight = 0.0 if rng.random() < zero or t == 1 else float(rng.uniform(0.31, 1))
            rows.append((t % 2, t // 2, i, float(rng.normal(shift + t, 1 + t)) if t != 2 else 0.0, weight))
    return rows, spark.createDataFrame(rows, "beam_id int, ifreq int, isample int, intensity double, weight double").withColumn("tile", F.lit(0))


def numpy_encode(x, w, cutoff):
    good = w >= cutoff
    if not good.any():
        return 1.0, 0.0, np.zeros(len(x), int)
    mean = x[good].mean()
    var = max((x[good] ** 2).mean() - mean**2, 1e-5 * mean**2, 0)
    scale = np.sqrt(var) / 25 if var else 1.0
    offset = mean - 128 * scale
    return scale, offset, np.floor(np.clip(good * (x - offset) / scale, 0, 255) + 0.5).astype(int)


@pytest.mark.parametrize("seed, cutoff", [(1, 0.3), (2, 0.7)])
def test_encode_matches_numpy_and_round_trips(spark, seed, cutoff):
    rows, df = samples(spark, seed)
    got = {(r.beam_id, r.ifreq, r.isample): r for r in codec.decode(codec.encode(df, ["beam_id", "ifreq"], cutoff), 1.1).collect()}
    stats = {(r.beam_id, r.ifreq): r for r in codec.tile_stats(df, ["beam_id", "ifreq"], cutoff).collect()}
    for key in {r[:2] for r in rows}:
        own = sorted(r for r in rows if r[:2] == key)
        x, w = np.array([r[3] for r in own]), np.array([r[4] for r in own])
        scale, offset, bytes_ = numpy_encode(x, w, cutoff)
        assert stats[key].scale == pytest.approx(scale) and stats[key].offset == pytest.approx(offset)
        for r, b, xi, wi in zip(own, bytes_, x, w):
            g = got[r[:3]]
            assert g.byte == b and g.decoded == pytest.approx(1.1 * (scale * b + offset))
            assert g.decoded_weight == float(b not in (0, 255))
            if g.decoded_weight:
                assert wi >= cutoff and abs(g.decoded / 1.1 - xi) <= scale * 0.51
            else:
                assert wi < cutoff or b in (0, 255)


def test_subset_bounds(spark):
    _, df = samples(spark, 3)
    enc = codec.encode(df, ["beam_id", "ifreq"])
    assert {r.isample for r in codec.decode_subset(enc, 4, 8, 32).collect()} == set(range(4, 12))
    for bad in ((-1, 4), (0, 0), (30, 4)):
        with pytest.raises(ValueError):
            codec.decode_subset(enc, *bad, 32)


def numpy_downsample(byte, scale, offset):
    """One output tile of byte[freq, 2 packets x ntp] with scales per freq-tile and packet."""
    ntp = byte.shape[1] // 2
    s, o = np.repeat(scale, ntp, axis=1), np.repeat(offset, ntp, axis=1)
    value = 0.5 * s[:, ::2] * (byte[:, ::2] + byte[:, 1::2]) + o[:, ::2]
    ok = (byte > 0) & (byte < 255)
    valid = ok[:, ::2] & ok[:, 1::2]
    n = valid.sum()
    mean = value[valid].sum() / max(n, 1)
    var = ((value[valid] - mean) ** 2).sum() / max(n, 1) + 1e-10 * mean**2
    new = 0.04 * (np.sqrt(var) if var > 0 else 1.0)
    off = mean - 128 * new
    return new, off, np.where(valid, np.floor(np.clip((value - off) / new, 0, 255) + 0.5), 0).astype(int)


def test_downsample_matches_numpy(spark):
    rng = np.random.default_rng(5)
    ntp, nup, tiles = 4, 2, 5
    byte = np.clip(rng.integers(-25, 281, (nup, tiles * 2 * ntp)), 0, 255)
    byte[:, 8:16] = 0
    scale, offset = rng.uniform(0.5, 2, (1, tiles * 2)), rng.normal(0, 9, (1, tiles * 2))
    rows = [(3, f, i, int(byte[f, i]), float(scale[0, i // ntp]), float(offset[0, i // ntp])) for f in range(nup) for i in range(byte.shape[1])]
    df = spark.createDataFrame(rows, "beam_id int, ifreq int, isample long, byte int, scale double, offset double")
    got = {(r.ifreq, r.isample): r for r in downsample.downsample(df, ntp, nup).collect()}
    for t in range(tiles):
        part = slice(t * 2 * ntp, (t + 1) * 2 * ntp)
        s, o, b = numpy_downsample(byte[:, part], np.repeat(scale[:, 2 * t : 2 * t + 2], nup, 0), np.repeat(offset[:, 2 * t : 2 * t + 2], nup, 0))
        for f in range(nup):
            for i in range(ntp):
                r = got[f, t * ntp + i]
                assert r.scale == pytest.approx(s, rel=1e-9) and r.offset == pytest.approx(o, rel=1e-9) and r.byte == b[f, i]
    with pytest.raises(ValueError):
        downsample.check_shape(1)
    levels = downsample.pyramid(df, 2, ntp, nup).groupBy("binning").count().collect()
    assert {r.binning: r["count"] for r in levels} == {2: byte.size // 2, 4: byte.size // 4}


def test_masks(spark):
    rng = np.random.default_rng(0)
    bits = rng.random((2, 64)) < 0.7
    df = spark.createDataFrame([(k, i, bool(bits[k, i])) for k in range(2) for i in range(64)], "beam_id int, isample long, bit boolean")
    half = downsample.downsample_mask(df, ["beam_id"])
    packed = downsample.pack_bits(half, ["beam_id"])
    want = np.packbits(bits[:, ::2] & bits[:, 1::2], axis=1, bitorder="little")
    assert {(r.beam_id, r.ibyte): r.packed for r in packed.collect()} == {(k, i): want[k, i] for k in range(2) for i in range(4)}
    assert {(r.beam_id, r.isample, r.bit) for r in downsample.unpack_bits(packed).collect()} == {(r.beam_id, r.isample, r.bit) for r in half.collect()}
    whole = spark.createDataFrame([(bytearray(want[0].tobytes()),)], "mask binary").select(downsample.mask_bits(F.col("mask"), 32).alias("b")).first().b
    assert whole == (bits[0, ::2] & bits[0, 1::2]).tolist()

"""Scalar column helpers: strict casts, formatting, bit and number helpers, sender keys, chunk times, JSON lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import NS_PER_COUNT, Grid

SPACES = r"[ \t\n\x0B\f\r]*"
INTEGER = rf"^{SPACES}[+-]?[0-9]+{SPACES}$"
REAL = rf"^{SPACES}[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?{SPACES}$"
RANGES = {"int": (-(2**31), 2**31 - 1), "bigint": (-(2**63), 2**63 - 1), "uint16": (0, 65535)}


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lexical_cast(text: str | Column, kind: str) -> Column:
    """text as int, bigint, uint16, float, double, boolean or string; null where it isn't one exactly.

    White space around numbers is fine, trailing junk and overflow are not; booleans are t, true, f, false in either
    case, without spaces.
    """
    text = _col(text)
    trimmed = F.regexp_replace(text, rf"^{SPACES}|{SPACES}$", "")
    if kind == "string":
        return text
    if kind == "boolean":
        return F.when(F.lower(text).isin("t", "true"), True).when(F.lower(text).isin("f", "false"), False)
    if kind in RANGES:
        low, high = RANGES[kind]
        value = F.when(text.rlike(INTEGER), trimmed).try_cast("decimal(38,0)")
        return F.when(value.between(F.lit(low).cast("decimal(38,0)"), F.lit(high).cast("decimal(38,0)")), value).cast("int" if kind == "uint16" else kind)
    if kind in ("float", "double"):
        value = F.when(text.rlike(REAL), trimmed).try_cast(kind)
        return F.when(F.abs(value) < float("inf"), value)
    raise ValueError(f"no such type: {kind}")


def is_power_of_two(n: str | Column) -> Column:
    """An error for numbers that aren't positive."""
    n = _col(n)
    return F.when(n <= 0, F.raise_error(F.lit("not positive")).cast("boolean")).otherwise(n.bitwiseAND(n - 1) == 0)


def round_down_to_power_of_two(n: str | Column) -> Column:
    n = _col(n).cast("long")
    for shift in (1, 2, 4, 8, 16, 32):
        n = n.bitwiseOR(F.shiftright(n, shift))
    return n - F.shiftright(n, 1)


def ceil_div(n: str | Column, k: int) -> Column:
    return F.floor((_col(n) + (k - 1)) / k)


def clamp(x: str | Column, low: float, high: float) -> Column:
    return F.least(F.greatest(_col(x), F.lit(low)), F.lit(high))


def sanitize(name: str | Column) -> Column:
    return F.translate(_col(name), "/-", "__")


def array_text(values: str | Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(_col(values), lambda x: x.cast("string")), " "), F.lit("]"))


def sender_key(ip: str | Column, port: str | Column) -> Column:
    return F.shiftleft(_col(ip).cast("long"), 32).bitwiseOR(_col(port).cast("long"))


def sender_name(key: str | Column) -> Column:
    """a.b.c.d:port of a sender key."""
    key = _col(key)
    parts = [F.shiftright(key, s).bitwiseAND(F.lit(255)).cast("string") for s in (56, 48, 40, 32)]
    return F.concat(F.concat_ws(".", *parts), F.lit(":"), key.bitwiseAND(F.lit(0xFFFFFFFF)).cast("string"))


def filename(pattern: str, stream: Column, beam: Column, chunk: Column, nchunk: Column, binning: Column, fpga0: Column, fpga_n: Column) -> Column:
    """A file name of a pattern; widths are least widths, wide values stay whole."""
    name = F.lit(pattern)
    for token, form, value in (
        ("(STREAM)", "%01d", stream), ("(BEAM)", "%04d", beam), ("(CHUNK)", "%08d", chunk), ("(NCHUNK)", "%02d", nchunk),
        ("(BINNING)", "%02d", binning), ("(FPGA0)", "%012d", fpga0), ("(FPGAN)", "%08d", fpga_n),
    ):
        name = F.replace(name, F.lit(token), F.format_string(form, value))
    return name


def chunk_time(fpga: str | Column, frame0_nano: str | Column, legacy_counts_per_sample: int | None = None) -> Column:
    """Seconds of an FPGA count. legacy: count it as samples once more, as old files' times did."""
    factor = NS_PER_COUNT * (legacy_counts_per_sample or 1)
    return (_col(frame0_nano) + _col(fpga) * F.lit(factor).cast("long")) * F.lit(1e-9)


def compressed_bound(n: str | Column, block: int = 8192) -> Column:
    """The most bytes that n bytes take in bitshuffle-LZ4 blocks: LZ4's bound and a length for each block, and a raw rest."""
    n = _col(n).cast("long")
    lz4 = lambda k: k + F.floor(k / 255) + 16 if isinstance(k, Column) else k + k // 255 + 16
    whole, rest = F.floor(n / block), n % block
    last = rest - rest % 8
    return whole * (lz4(block) + 4) + F.when(last > 0, lz4(last) + 4).otherwise(0) + rest % 8


def slab_bytes(nupfreq: str | Column, nrfifreq: str | Column, grid: Grid) -> Column:
    """Bytes of a chunk's data, scales, offsets and mask, each rounded up to 64, for shapes that are columns."""
    up = lambda n: ceil_div(n, 64) * 64
    data, mask = _col(nupfreq) * (grid.nfreq_coarse * grid.nt_per_chunk), _col(nrfifreq) * (grid.nt_per_chunk // 8)
    return (up(data) + 2 * (-(-4 * grid.nscales // 64) * 64) + up(mask)).cast("long")


def json_integer(text: str | Column, key: str) -> Column:
    """An integer of a JSON object; null for anything else."""
    raw = F.get_json_object(_col(text), f"$.{key}")
    return lexical_cast(raw, "bigint")


def usec_between(a: str | Column, b: str | Column) -> Column:
    return F.timestamp_diff("MICROSECOND", _col(a), _col(b))


def find_channel(channels: str | Column, channel: str | Column) -> Column:
    """Place of a channel in a packet's list, from 0; -1 where it isn't in it."""
    return F.array_position(_col(channels), _col(channel)) - 1


def product(values: str | Column) -> Column:
    return F.aggregate(_col(values), F.lit(1.0), lambda acc, x: acc * x)


def total(values: str | Column) -> Column:
    return F.aggregate(_col(values), F.lit(0.0), lambda acc, x: acc + x)

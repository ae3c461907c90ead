"""Binary chunk codecs: bitshuffle with LZ4 blocks, and array-of-21 MessagePack chunk files.

Shuffled blocks: the bytes' bits are transposed, so that bit k of all bytes lies together; each block of 8192 bytes is
LZ4-compressed behind its length (4 bytes, big-endian); a rest of fewer than 8 bytes follows raw.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import qualified

BLOCK = 8192
# The title and the order of the items of chunk files.
TITLE = "assembled_chunk in msgpack format"
FIELDS = (
    "title", "version", "compression", "data_size", "beam_id", "nupfreq", "nt_per_packet", "counts_per_sample", "nt_coarse", "nscales", "ndata",
    "fpga_begin", "fpga_n", "binning", "scales", "offsets", "data", "frame0_nano", "nrfifreq", "has_rfi_mask", "rfi_mask",
)
VERSION_1_FIELDS = 17


def bit_transpose(data: bytes) -> bytes:
    return np.packbits(np.unpackbits(np.frombuffer(data, np.uint8)[:, None], axis=1, bitorder="little").T, axis=1, bitorder="little").tobytes()


def bit_untranspose(data: bytes) -> bytes:
    return np.packbits(np.unpackbits(np.frombuffer(data, np.uint8).reshape(8, -1), axis=1, bitorder="little").T, axis=1, bitorder="little").tobytes()


def _steps(n: int) -> Iterator[tuple[int, int]]:
    whole = n - n % 8
    for at in range(0, whole, BLOCK):
        yield at, min(BLOCK, whole - at)


def bitshuffle_compress(data: bytes) -> bytes:
    codec, out = pa.Codec("lz4_raw"), []
    for at, size in _steps(len(data)):
        packed = codec.compress(bit_transpose(data[at : at + size]), asbytes=True)
        out += [struct.pack(">I", len(packed)), packed]
    return b"".join(out) + data[len(data) - len(data) % 8 :]


def bitshuffle_decompress(data: bytes, size: int) -> bytes:
    codec, out, at = pa.Codec("lz4_raw"), [], 0
    for _, n in _steps(size):
        (length,) = struct.unpack_from(">I", data, at)
        out.append(bit_untranspose(codec.decompress(data[at + 4 : at + 4 + length], n, asbytes=True)))
        at += 4 + length
    return b"".join(out) + data[at:]


def _pack(value) -> bytes:
    """A value in MessagePack; integers of 64 bits, strings, bytes, booleans and lists of these."""
    if isinstance(value, bool):
        return b"\xc3" if value else b"\xc2"
    if isinstance(value, int):
        if 0 <= value < 128:
            return bytes([value])
        if -32 <= value < 0:
            return struct.pack("b", value)
        return b"\xcf" + struct.pack(">Q", value) if value >= 0 else b"\xd3" + struct.pack(">q", value)
    if isinstance(value, str):
        raw = value.encode()
        return (bytes([0xA0 | len(raw)]) if len(raw) < 32 else b"\xdb" + struct.pack(">I", len(raw))) + raw
    if isinstance(value, (bytes, bytearray)):
        return b"\xc6" + struct.pack(">I", len(value)) + bytes(value)
    return (bytes([0x90 | len(value)]) if len(value) < 16 else b"\xdc" + struct.pack(">H", len(value))) + b"".join(map(_pack, value))


# MessagePack's type bytes with a fixed-size number, and those with a length.
_NUMBERS = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
_LENGTHS = {0xC4: (">B", "bin"), 0xC5: (">H", "bin"), 0xC6: (">I", "bin"), 0xD9: (">B", "str"), 0xDA: (">H", "str"), 0xDB: (">I", "str"), 0xDC: (">H", "list"), 0xDD: (">I", "list")}


def _unpack(data: bytes, at: int = 0):
    kind = data[at]
    at += 1
    if kind < 0x80:
        return kind, at
    if kind >= 0xE0:
        return kind - 256, at
    if kind in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[kind], at
    if kind in _NUMBERS:
        return struct.unpack_from(_NUMBERS[kind], data, at)[0], at + struct.calcsize(_NUMBERS[kind])
    if 0xA0 <= kind < 0xC0:
        n, what = kind & 0x1F, "str"
    elif 0x90 <= kind < 0xA0:
        n, what = kind & 0x0F, "list"
    elif kind in _LENGTHS:
        form, what = _LENGTHS[kind]
        n = struct.unpack_from(form, data, at)[0]
        at += struct.calcsize(form)
    else:
        raise ValueError(f"unsupported type byte {kind:#x}")
    if what == "list":
        out = []
        for _ in range(n):
            value, at = _unpack(data, at)
            out.append(value)
        return out, at
    raw = data[at : at + n]
    if len(raw) < n:
        raise ValueError("file is cut short")
    return (raw.decode() if what == "str" else raw), at + n


def pack_chunk(chunk: dict, compress: bool = False) -> bytes:
    """A chunk file (version 2). Compression is dropped where it doesn't save anything. A mask that is announced must be there."""
    if chunk.get("nrfifreq") and not chunk.get("has_rfi_mask"):
        raise ValueError("the chunk's mask has not been filled")
    data = packed = bytes(chunk["data"])
    if compress:
        packed = bitshuffle_compress(data)
    small = compress and len(packed) < len(data)
    values = chunk | {"title": TITLE, "version": 2, "compression": int(small), "data": packed if small else data, "data_size": len(packed if small else data)}
    defaults = {"frame0_nano": 0, "nrfifreq": 0, "has_rfi_mask": False, "rfi_mask": b""}
    return _pack([values.get(name, defaults.get(name)) for name in FIELDS])


def unpack_chunk(data: bytes) -> dict:
    """A chunk of a file of version 1 (17 items) or 2 (21 items)."""
    items, _ = _unpack(data)
    if not isinstance(items, list) or items[:1] != [TITLE]:
        raise ValueError("not a chunk file")
    version = items[1]
    if (version, len(items)) not in ((1, VERSION_1_FIELDS), (2, len(FIELDS))):
        raise ValueError(f"version {version} with {len(items)} items")
    chunk = {"frame0_nano": 0, "nrfifreq": 0, "has_rfi_mask": False, "rfi_mask": b""} | dict(zip(FIELDS, items))
    if len(chunk["data"]) != chunk["data_size"]:
        raise ValueError("data size differs")
    if chunk["compression"]:
        chunk["data"] = bitshuffle_decompress(chunk["data"], chunk["ndata"])
    if len(chunk["data"]) != chunk["ndata"] or len(chunk["scales"]) != 4 * chunk["nscales"]:
        raise ValueError("array sizes differ")
    return chunk


CHUNK = (
    "beam_id int, nupfreq int, nt_per_packet int, counts_per_sample int, nt_coarse int, nscales int, ndata int, fpga_begin long, fpga_n long, binning int, "
    "scales binary, offsets binary, data binary, frame0_nano long, nrfifreq int, has_rfi_mask boolean, rfi_mask binary"
)
COLUMNS = [tuple(p.split()) for p in CHUNK.split(", ")]
ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}


def chunk_payloads(chunks: DataFrame, compress: bool = False) -> DataFrame:
    """(beam_id, fpga_begin, payload): chunk files as binary rows."""

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            columns = [[r["beam_id"] for r in rows], [r["fpga_begin"] for r in rows], [pack_chunk(r, compress) for r in rows]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.binary()))], names=["beam_id", "fpga_begin", "payload"])

    return chunks.select(*[F.col(name).cast({"int": "int", "long": "long"}.get(kind, kind)) for name, kind in COLUMNS]).mapInArrow(run, "beam_id int, fpga_begin long, payload binary")


def parse_payloads(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Chunks of binary rows."""

    def run(batches):
        for batch in batches:
            chunks = [unpack_chunk(p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([c[name] for c in chunks], ARROW[kind]) for name, kind in COLUMNS], names=[name for name, _ in COLUMNS])

    return payloads.select(F.col(column)).mapInArrow(run, CHUNK)


#: A chunk's items before its arrays take fewer bytes.
HEAD_BYTES = 512


def leading_items(data: bytes) -> dict:
    """The items before the arrays, from the first HEAD_BYTES of a chunk file."""
    count, at = (data[0] & 0x0F, 1) if 0x90 <= data[0] < 0xA0 else (struct.unpack_from(">H", data, 1)[0], 3) if data[0] == 0xDC else (0, 0)
    items: list = []
    while len(items) < min(count, FIELDS.index("scales")):
        value, at = _unpack(data, at)
        items.append(value)
    if items[:1] != [TITLE] or len(items) < FIELDS.index("scales"):
        raise ValueError("not a chunk file")
    return dict(zip(FIELDS, items))


def _source(spark: SparkSession) -> str:
    from .chunk_source import ChunkFiles

    spark.dataSource.register(ChunkFiles)
    return ChunkFiles.name()


def read_chunk_files(spark: SparkSession, path: str, beams: Sequence[int] = (), fpga: tuple[int, int] | None = None) -> DataFrame:
    """Chunks of all chunk files below a path; other files have other endings. Of files for other beams, or that don't meet
    the FPGA counts [a, b), only the leading items are read; so it is with filters, where Spark pushes them into sources of
    Python (``spark.sql.python.filterPushdown.enabled``)."""
    reader = spark.read.format(_source(spark)).option("path", qualified(spark, path)).option("push", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    reader = reader.option("beams", ",".join(map(str, beams))) if beams else reader
    return (reader.option("fpga", f"{fpga[0]},{fpga[1]}") if fpga else reader).load()


def write_chunk_table(chunks: DataFrame, path: str, compress: bool = False) -> None:
    """Chunk files as rows of a Parquet table by beam; Spark's commit protocol makes them appear at once or not at all."""
    chunk_payloads(chunks, compress).write.partitionBy("beam_id").option("compression", "none").parquet(path)


def _carried(rows: DataFrame, path: str, data: str) -> DataFrame:
    """rows(filename, payload or source, ...) written, with the status and bytes of each."""
    spark, path, job = rows.sparkSession, qualified(rows.sparkSession, path), uuid.uuid4().hex
    rows.write.format(_source(spark)).option("path", path).option("job", job).mode("append").save()
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rows.columns if c != data)
    return spark.read.schema(f"{fields}, status string, nbytes long").parquet(f"{path}/_status-{job}")


def write_chunk_files(payloads: DataFrame, path: str) -> DataFrame:
    """Each of payloads(filename, payload, ...) as a file below path, which read_chunk_files() reads: (..., status, nbytes).

    Files appear under their names once every task has succeeded; a job that fails leaves none. One that exists with other
    bytes stays and its request has FAILED; with the same bytes it has SUCCEEDED, so jobs can be run again. The files are
    there when this returns; the statuses are a table below path.
    """
    return _carried(payloads, path, "payload")


def carry_out(planned: DataFrame, payloads: DataFrame, chunk: Sequence[str], path: str) -> DataFrame:
    """Carry out planned(filename, device_name, action, chunk...) writes of payloads(chunk..., payload) below path.

    Written files come first, then links to the file that the same device has of the chunk; skipped ones share the status
    of what they repeat. Returns planned's columns with status and nbytes, once all is done.
    """
    keys = [*chunk, "device_name"]
    writes = planned.filter("action = 'write'").join(payloads.select(*chunk, "payload"), list(chunk))
    done = write_chunk_files(writes, path)
    first = done.select(*keys, F.col("filename").alias("source"), F.col("status").alias("_status"), F.col("nbytes").alias("_nbytes"))
    links = planned.filter("action = 'link'").join(first.filter("_status = 'SUCCEEDED'"), keys).drop("_status", "_nbytes")
    linked = _carried(links, path, "source")
    rest = planned.filter("action <> 'write'").join(linked.select("filename", *keys), ["filename", *keys], "left_anti").join(first.drop("source"), keys, "left")
    rest = rest.select(*planned.columns, F.when(F.col("action") == "skip", F.coalesce("_status", F.lit("FAILED"))).otherwise("FAILED").alias("status"), F.coalesce("_nbytes", F.lit(0)).alias("nbytes"))
    columns = [*planned.columns, "status", "nbytes"]
    return done.select(*columns).unionByName(linked.select(*columns)).unionByName(rest.select(*columns))


def bitshuffle_column(df: DataFrame, column: str = "data") -> DataFrame:
    """df with `packed`, the column's bitshuffle-LZ4 form, and `restored`, what that unpacks to."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches):
        for batch in batches:
            data = batch.column(batch.schema.get_field_index(column)).to_pylist()
            packed = [bitshuffle_compress(d) for d in data]
            restored = [bitshuffle_decompress(p, len(d)) for p, d in zip(packed, data)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(packed, pa.binary()), pa.array(restored, pa.binary())], names=[*batch.schema.names, "packed", "restored"])

    return df.mapInArrow(run, f"{fields}, packed binary, restored binary")

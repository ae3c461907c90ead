"""Token ids in files of canonical, length-limited Huffman codes, and back.

Writing: (1) texts become ids once, in a scratch table; (2) global counts of ids, at most one row a vocabulary entry,
reach the driver, which finds optimal code lengths by package-merge, of at most 16 bits or, beyond 2^16 used ids, as few
more as they need; canonical codes follow from the
lengths; (3) documents are dealt to ranges of (doc_id, tokens, a hash of the ids), sorted and encoded; ranges come from
Spark's samples, their number is in proportion to the tokens, and a range is a file; (4) consecutive documents fill blocks. A block decodes alone: it lists its documents and a bit offset every
CHECKPOINT tokens and at each document. Files are Parquet rows (file, block, first, tokens, payload) beside a one-row
table of code lengths; `first` counts the file's tokens before the block.

Reading decodes a block by one table of 2^longest entries; all stretches between checkpoints advance side by side.

Block payload (little-endian): magic "HTB1", documents u32, checkpoints u32, bytes of code u64; then doc ids i64, null
flags u8, token counts u64, checkpoints u64 (bit offset in the code), code, three zero bytes. Every document starts at
a byte, and has ceil(tokens / CHECKPOINT) checkpoints.

Defined results: a null or empty text has its end id only; a very long one is one document in one block; null ids come
first; rows that repeat an id are separate documents in the order of their lengths; extra columns are ignored; an empty
table gives no blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SMALL_BATCHES, new_path, returned, settings, written
from .tokens import CACHE_BYTES, ID, token_rows

MAGIC, HEAD = b"HTB1", struct.Struct("<4sIIQ")
LONGEST = 16
CHECKPOINT = 512
BLOCK_TOKENS = 1 << 20
#: A file has about so many tokens; where that would make more than MOST_FILES files, they have more tokens each.
FILE_TOKENS, MOST_FILES = 1 << 23, 1 << 15
#: Tokens whose arrays exist at one time while documents are encoded.
STEP_TOKENS = 1 << 17


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal prefix-code lengths of at most `longest` bits, or as many as the used ids need (package-merge); 0 for ids
    that don't occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    longest = max(longest, (len(used) - 1).bit_length())
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    merged, levels = weights, []
    for level in range(longest):
        if level:
            pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
            both = np.concatenate([weights, pairs])
            rank = np.argsort(both, kind="stable")
            merged, single = both[rank], rank < len(weights)
        else:
            single = np.ones(len(weights), bool)
        levels.append(single)
    take = 2 * len(weights) - 2
    for single in reversed(levels):
        singles = int(single[:take].sum())
        lengths[order[:singles]] += 1
        take = 2 * (take - singles)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in ascending order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint32)
    code = last = 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)).tolist():
        if n := int(lengths[i]):
            code <<= n - last
            codes[i], code, last = code, code + 1, n
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, code length) for each value of the next bits, as many as the longest code has."""
    longest = max(1, int(lengths.max(initial=0)))
    ids, sizes = np.zeros(1 << longest, np.uint32), np.zeros(1 << longest, np.uint8)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    spans = 1 << (longest - lengths[order].astype(np.int64))
    filled = int(spans.sum())
    ids[:filled], sizes[:filled] = np.repeat(order, spans), np.repeat(lengths[order], spans)
    return ids, sizes


def encode(docs: list[np.ndarray], lengths: np.ndarray, codes: np.ndarray) -> list[tuple[bytes, np.ndarray]]:
    """Each document's code in whole bytes, and its bit offsets every CHECKPOINT tokens; all documents at once."""
    ids = np.concatenate(docs) if docs else np.empty(0, np.uint32)
    bounds = np.cumsum([0, *map(len, docs)])
    sizes = lengths[ids].astype(np.int64)
    ends = np.append(0, np.cumsum(sizes))
    begins = ends[bounds]  # bits before each document, were there no gaps
    room = (np.diff(begins) + 7) // 8
    at = np.append(0, np.cumsum(room))
    starts = ends[:-1] + np.repeat(8 * at[:-1] - begins[:-1], np.diff(bounds))
    words = np.zeros(int(at[-1]) // 4 + 2, np.uint64)
    if len(ids):
        shifted = codes[ids].astype(np.uint64) << (np.uint64(64) - (starts & 31).astype(np.uint64) - sizes.astype(np.uint64))
        word = starts >> 5
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[first]] += np.add.reduceat(shifted >> np.uint64(32), first)
        words[word[first] + 1] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), first)
    data = words.astype(">u4").tobytes()
    places = zip(bounds[:-1].tolist(), bounds[1:].tolist(), at[:-1].tolist(), at[1:].tolist())
    return [(data[a:b], starts[i:j:CHECKPOINT] - 8 * a) for i, j, a, b in places]


def few_tokens(rows: list[tuple]) -> Iterator[list[tuple]]:
    """Rows (id, tokens, ...) in lists of at most STEP_TOKENS tokens, or one row."""
    held, size = [], 0
    for row in rows:
        if held and size + row[1] > STEP_TOKENS:
            yield held
            held, size = [], 0
        held.append(row)
        size += row[1]
    if held:
        yield held


def pack_block(doc_ids: list, tokens: list[int], codes: list[bytes], marks: list[np.ndarray]) -> bytes:
    at = np.concatenate(([0], np.cumsum([len(c) for c in codes])))
    offsets = [m.astype(np.uint64) + np.uint64(8 * a) for m, a in zip(marks, at.tolist())]
    offsets = np.concatenate(offsets) if offsets else np.empty(0, np.uint64)
    body = b"".join(codes)
    head = HEAD.pack(MAGIC, len(doc_ids), len(offsets), len(body))
    ids = np.array([0 if i is None else i for i in doc_ids], "<i8")
    null = np.array([i is None for i in doc_ids], np.uint8)
    return b"".join([head, ids.tobytes(), null.tobytes(), np.array(tokens, "<u8").tobytes(), offsets.astype("<u8").tobytes(), body, b"\0\0\0"])


def unpack_block(payload: bytes, table: tuple[np.ndarray, np.ndarray]) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, their token counts, and all their token ids."""
    magic, n, m, size = HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a token block")
    at = HEAD.size
    doc_ids = np.frombuffer(payload, "<i8", n, at).tolist()
    null = np.frombuffer(payload, np.uint8, n, at := at + 8 * n)
    tokens = np.frombuffer(payload, "<u8", n, at := at + n).astype(np.int64)
    place = np.frombuffer(payload, "<u8", m, at := at + 8 * n).astype(np.int64)
    data = np.frombuffer(payload, np.uint8, size + 3, at + 8 * m).astype(np.uint32)
    window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    ids, sizes = table
    longest = len(ids).bit_length() - 1  # at most 25: a window has that many from any bit of its first byte

    stretches = -(-tokens // CHECKPOINT)
    counts = np.full(m, CHECKPOINT, np.int64)
    last = np.cumsum(stretches)[tokens > 0] - 1
    counts[last] = tokens[tokens > 0] - (stretches[tokens > 0] - 1) * CHECKPOINT
    target = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    place, target, counts = place[order], target[order], counts[order]
    active = np.searchsorted(-counts, -np.arange(CHECKPOINT), side="left")  # stretches with more than i tokens
    out = np.empty(int(tokens.sum()), ID)
    for i in range(int(counts[0]) if m else 0):
        k = active[i]
        now = place[:k]
        code = (window[now >> 3] >> (32 - longest - (now & 7)).astype(np.uint32)) & np.uint32((1 << longest) - 1)
        out[target[:k] + i] = ids[code]
        place[:k] += sizes[code]
    return [None if z else i for i, z in zip(doc_ids, null)], tokens, out


class TokenFiles:
    """A folder of token files: `blocks` and `code` tables."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def lengths(self) -> np.ndarray:
        return np.frombuffer(self.spark.read.parquet(f"{self.path}/code").first()["lengths"], np.uint8)

    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/blocks")

    def documents(self, schema: str, work) -> DataFrame:
        """work(doc_ids, token counts, all ids) -> columns after (file, first) for each block; one row a document."""
        lengths = self.lengths()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = decoding_table(lengths)
            for batch in batches:
                for file, first, payload in zip(*(c.to_pylist() for c in batch.columns)):
                    doc_ids, tokens, ids = unpack_block(payload, table)
                    starts = first + np.cumsum(tokens) - tokens
                    own = work(doc_ids, tokens, ids)
                    columns = {"file": pa.array([file] * len(doc_ids), pa.int64()), "local": pa.array(starts, pa.int64()), **own}
                    yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        return self.blocks().select("file", "first", "payload").mapInArrow(run, f"file long, local long, {schema}")

    def bases(self) -> DataFrame:
        """(file, base): tokens in the files before; by default there are MOST_FILES at most."""
        totals = self.blocks().groupBy("file").agg(F.sum("tokens").alias("tokens"))
        earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
        return totals.select("file", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("base"))

    def digests(self) -> DataFrame:
        """(doc_id, start, n_tokens, ids_crc32) from the files."""

        def work(doc_ids, tokens, ids):
            ends = np.cumsum(tokens)
            crc = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), tokens.tolist())]
            return {"doc_id": pa.array(doc_ids, pa.int64()), "n_tokens": pa.array(tokens, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}

        rows = self.documents("doc_id long, n_tokens long, ids_crc32 long", work)
        return rows.join(self.bases(), "file").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")

    def ids(self) -> DataFrame:
        """(doc_id, ids) from the files."""

        def work(doc_ids, tokens, ids):
            offsets = pa.array(np.concatenate(([0], np.cumsum(tokens))), pa.int32())
            return {"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int64)))}

        return self.documents("doc_id long, ids array<long>", work).select("doc_id", "ids")


def write_token_files(docs: DataFrame, spec: str, end_id: int, path: str | None = None, file_tokens: int | None = None, cache_bytes: int = CACHE_BYTES) -> TokenFiles:
    """Ids of every row of docs(doc_id, text), each followed by end_id, in ascending doc_id order below path.

    file_tokens: about the tokens of a file, which one task sorts; by default FILE_TOKENS, or what makes MOST_FILES files.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "token-files")

    def tokenised(encoded) -> Iterator[pa.RecordBatch]:
        for doc_ids, data in encoded:
            narrow = [np.frombuffer(d, ID).astype("<u2").tobytes() if wide == 2 else d for d in data]
            columns = [pa.array(doc_ids, pa.int64()), pa.array([len(d) // ID.itemsize for d in data], pa.int64()), pa.array(narrow, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids"])

    import tokenizers

    vocabulary = max(tokenizers.Tokenizer.from_str(spec).get_vocab_size(), end_id + 1)
    wide = 2 if vocabulary <= 1 << 16 else 4
    kind = f"<u{wide}"
    with settings(spark, **SMALL_BATCHES):
        tokens = written(token_rows(docs, spec, end_id, tokenised, "doc_id long, n_tokens long, ids binary", cache_bytes), "ids")

    def counted(batches) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(vocabulary, np.int64)
        for batch in batches:
            data = b"".join(batch.column(0).to_pylist())
            seen += np.bincount(np.frombuffer(data, kind), minlength=vocabulary)
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[used])], names=["id", "n"])

    counts = np.zeros(vocabulary, np.int64)
    for row in tokens.select("ids").mapInArrow(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row["id"]] = row["n"]
    lengths = code_lengths(counts)
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/code")

    total = int(counts.sum())
    files = max(1, round(total / (file_tokens or max(FILE_TOKENS, total / MOST_FILES))))

    def blocked(batches) -> Iterator[pa.RecordBatch]:
        codes = canonical_codes(lengths)
        held: list[tuple] = []
        state = {"file": TaskContext.get().partitionId(), "block": 0, "first": 0, "tokens": 0}  # ranges go by partition

        def flush() -> pa.RecordBatch:
            payload = pack_block([h[0] for h in held], [h[1] for h in held], [h[2] for h in held], [h[3] for h in held])
            row = [state["file"], state["block"], state["first"], state["tokens"]]
            held.clear()
            state.update(block=state["block"] + 1, first=state["first"] + state["tokens"], tokens=0)
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in row), pa.array([payload], pa.binary())], names=["file", "block", "first", "tokens", "payload"])

        for batch in batches:
            for rows in few_tokens(list(zip(*(c.to_pylist() for c in batch.columns)))):
                coded = encode([np.frombuffer(ids, kind) for _, _, ids in rows], lengths, codes)
                for (doc_id, n_tokens, _), code in zip(rows, coded):
                    if held and state["tokens"] + n_tokens > BLOCK_TOKENS:
                        yield flush()
                    held.append((doc_id, n_tokens, *code))
                    state["tokens"] += n_tokens
        if held:
            yield flush()
        returned()

    order = ["doc_id", "n_tokens", "hash"]  # rows that repeat an id can be split over files, too
    sent = tokens.withColumn("hash", F.xxhash64("ids")).repartitionByRange(files, *order)
    ordered = sent.sortWithinPartitions(*order, "ids").drop("hash")
    with settings(spark, **SMALL_BATCHES):
        ordered.mapInArrow(blocked, "file long, block long, first long, tokens long, payload binary").write.option("compression", "none").parquet(f"{path}/blocks")
    return TokenFiles(spark, path)

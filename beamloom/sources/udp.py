"""UDP packets as a streaming source (Python Data Source API).

A receiver thread of the driver appends datagrams to a log of part files in a shared folder, which is what makes them
replayable: offsets count rows of the log, and partitions read it on the executors; what Spark has committed is trimmed.
spark.readStream.format("udp_packets") with options ip, port, folder (with a scheme, see shared.qualified()),
maxRowsPerTrigger, capacity. End-of-stream packets are kept; downstream classification counts them.
"""

from __future__ import annotations

import socket
import threading
import time
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.ipc
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from .shared import opened, put_file

SCHEMA = "arrival_seq bigint, recv_us bigint, sender_ip bigint, sender_port int, payload binary"

FIELDS = tuple(part.split()[0] for part in SCHEMA.split(", "))
TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())


def ip_number(text: str) -> int:
    return int.from_bytes(socket.inet_aton(text), "big")


class PacketLog:
    """Part files of packets, named by their first row, in a folder that driver and executors share, on any file system that
    Arrow knows; a file appears by renaming and never changes. Parts that are consumed are trimmed, so the folder holds what
    is still to be read. Empty files named by a number tell up to which row the log is `trimmed` and batches are `planned`,
    and how many packets were `dropped`, whole lists at a time, because more than `capacity` rows waited."""

    def __init__(self, folder: str, capacity: int | None = None):
        self.files, self.folder = opened(folder)
        self.capacity = capacity
        self.files.create_dir(self.folder, recursive=True)
        self.next = self.end()

    def _names(self) -> list[str]:
        return [f.base_name for f in self.files.get_file_info(fs.FileSelector(self.folder))]

    def parts(self) -> list[tuple[int, int]]:
        names = [n.removesuffix(".part").split("-") for n in self._names() if n.endswith(".part")]
        return sorted((int(a), int(b)) for a, b in names)

    def mark(self, what: str) -> int:
        return max((int(n.split(".")[0]) for n in self._names() if n.endswith(f".{what}")), default=0)

    def set_mark(self, what: str, number: int) -> None:
        """The new mark is there before the old ones go."""
        old = [n for n in self._names() if n.endswith(f".{what}") and int(n.split(".")[0]) < number]
        put_file(self.files, f"{self.folder}/{number:020d}.{what}", b"")
        for name in old:
            self.files.delete_file(f"{self.folder}/{name}")

    def end(self) -> int:
        """The row after the last."""
        return max([self.mark("trimmed"), *(first + n for first, n in self.parts())])

    def append(self, packets: list[tuple]) -> None:
        if packets and self.capacity is not None and self.next - self.mark("trimmed") + len(packets) > self.capacity:
            self.set_mark("dropped", self.mark("dropped") + len(packets))
        elif packets:
            columns = [range(self.next, self.next + len(packets)), *zip(*packets)]
            batch = pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, TYPES)], names=FIELDS)
            with pa.BufferOutputStream() as out:
                with pa.ipc.new_file(out, batch.schema) as f:
                    f.write(batch)
                put_file(self.files, f"{self.folder}/{self.next:020d}-{len(packets)}.part", out.getvalue().to_pybytes())
            self.next += len(packets)

    def trim(self, row: int) -> None:
        """Parts that end at or before the row go; a part that goes on stays whole."""
        over = [(first, n) for first, n in self.parts() if first + n <= row]
        if over:
            self.set_mark("trimmed", over[-1][0] + over[-1][1])
        for first, n in over:
            self.files.delete_file(f"{self.folder}/{first:020d}-{n}.part")

    def read(self, start: int, end: int, parts: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        for first, n in parts:
            if first < end and first + n > start:
                with self.files.open_input_file(f"{self.folder}/{first:020d}-{n}.part") as f, pa.ipc.open_file(f) as whole:
                    batch = whole.get_batch(0)
                low, high = max(start - first, 0), min(end - first, n)
                yield batch.slice(low, high - low)


def receive(sock: socket.socket, log: PacketLog, stopped: threading.Event, most: int = 16384, most_bytes: int = 8 << 20, timeout: float = 0.25) -> None:
    """Batch datagrams until a list is full or `timeout` seconds old, then append it."""
    sock.settimeout(timeout / 5)
    while not stopped.is_set():
        held, size, began = [], 0, time.monotonic()
        while len(held) < most and size < most_bytes and time.monotonic() - began < timeout:
            try:
                payload, (ip, port) = sock.recvfrom(1 << 16)
            except TimeoutError:
                continue
            held.append((time.time_ns() // 1000, ip_number(ip), port, payload))
            size += len(payload)
        log.append(held)


class _Range(InputPartition):
    """Rows [start, end) and the parts that hold them, as the driver has listed them."""

    def __init__(self, start: int, end: int, parts: list[tuple[int, int]]):
        super().__init__(start)
        self.start, self.end, self.parts = start, end, parts


class _Reader(DataSourceStreamReader):
    """maxRowsPerTrigger: most rows of a batch. capacity: most rows that wait; further packets are dropped and counted."""

    def __init__(self, options: dict):
        self.folder = options["folder"]
        self.port, self.ip = int(options.get("port", 0)), options.get("ip", "127.0.0.1")
        limits = {k.lower(): int(v) for k, v in options.items() if k.lower() in ("maxrowspertrigger", "capacity")}
        self.most, self.capacity = limits.get("maxrowspertrigger"), limits.get("capacity")
        self.log = None

    def _started(self) -> PacketLog:
        if self.log is None:
            self.log, self.stopped = PacketLog(self.folder, self.capacity), threading.Event()
            if self.port:
                self.sock = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
                self.sock.bind((self.ip, self.port))
                threading.Thread(target=receive, args=(self.sock, self.log, self.stopped), daemon=True).start()
        return self.log

    def initialOffset(self) -> dict:
        return {"row": PacketLog(self.folder).mark("trimmed")}

    def latestOffset(self) -> dict:
        log = self._started()
        end = log.end()
        if self.most is not None:  # no batch ends beyond what was planned, so none begins there either
            end = min(end, max(log.mark("planned"), log.mark("trimmed")) + self.most)
        return {"row": end}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        log = PacketLog(self.folder)
        log.set_mark("planned", max(end["row"], log.mark("planned")))
        step, parts = max(1, -(-(end["row"] - start["row"]) // 8)), log.parts()
        cuts = [(at, min(at + step, end["row"])) for at in range(start["row"], end["row"], step)]
        return [_Range(a, b, [(first, n) for first, n in parts if first < b and first + n > a]) for a, b in cuts]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        return PacketLog(self.folder).read(partition.start, partition.end, partition.parts)

    def commit(self, end: dict) -> None:
        PacketLog(self.folder).trim(end["row"])

    def stop(self) -> None:
        if self.log is not None and self.port:
            self.stopped.set()
            self.sock.close()


class UdpPackets(DataSource):
    @classmethod
    def name(cls) -> str:
        return "udp_packets"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> _Reader:
        return _Reader(self.options)

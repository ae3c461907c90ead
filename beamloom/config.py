"""Grid and stream parameters, checked on construction."""

from __future__ import annotations

from dataclasses import dataclass, field

# The wire format's and the stream's limits.
DT_FPGA = 2.56e-6
NS_PER_COUNT = 2560
MAX_INPUT_PACKET = 9000
MAX_OUTPUT_PACKET = 8910
MAX_BEAM_ID = 65535
MAX_NUPFREQ = 64
MAX_NT_PER_PACKET = 1024
MAX_COUNTS_PER_SAMPLE = 3200
MAX_OUTPUT_GBPS = 10.0
DEFAULT_UDP_PORT = 6677
HEADER_BYTES = 24
PROTOCOL_VERSION = 1
MASKED_BYTES = (0, 255)


def is_power_of_two(n: int) -> bool:
    if n <= 0:
        raise ValueError(f"{n} is not positive")
    return n & (n - 1) == 0


def _check(holds: bool, message: str) -> None:
    if not holds:
        raise ValueError(message)


@dataclass(frozen=True)
class Grid:
    """Shape of a chunk. Coarse channels and samples per chunk are parameters, so tests can use small ones."""

    nupfreq: int = 16
    nt_per_packet: int = 16
    counts_per_sample: int = 384
    nfreq_coarse: int = 1024
    nt_per_chunk: int = 1024

    def __post_init__(self):
        _check(1 <= self.nupfreq <= MAX_NUPFREQ, f"nupfreq {self.nupfreq} is not in 1..{MAX_NUPFREQ}")
        _check(1 <= self.nt_per_packet <= MAX_NT_PER_PACKET and is_power_of_two(self.nt_per_packet), f"nt_per_packet {self.nt_per_packet} is not a power of two up to {MAX_NT_PER_PACKET}")
        _check(1 <= self.counts_per_sample <= MAX_COUNTS_PER_SAMPLE, f"counts_per_sample {self.counts_per_sample} is not in 1..{MAX_COUNTS_PER_SAMPLE}")
        _check(self.nfreq_coarse >= 1, "nfreq_coarse is not positive")
        _check(self.nt_per_chunk % self.nt_per_packet == 0, "nt_per_chunk is not a multiple of nt_per_packet")

    @property
    def nt_coarse(self) -> int:
        return self.nt_per_chunk // self.nt_per_packet

    @property
    def nscales(self) -> int:
        return self.nfreq_coarse * self.nt_coarse

    @property
    def ndata(self) -> int:
        return self.nfreq_coarse * self.nupfreq * self.nt_per_chunk

    @property
    def counts_per_chunk(self) -> int:
        return self.nt_per_chunk * self.counts_per_sample

    def rfi_mask_bytes(self, nrfifreq: int) -> int:
        return nrfifreq * self.nt_per_chunk // 8

    def slab_bytes(self, nrfifreq: int = 0) -> int:
        """Bytes of a chunk's data, scales, offsets and mask, each rounded up to 64."""
        up = lambda n: -(-n // 64) * 64
        return up(self.ndata) + 2 * up(4 * self.nscales) + up(self.rfi_mask_bytes(nrfifreq))


@dataclass(frozen=True)
class StreamConfig:
    """An input stream: its beams, its grid, and what to do with packets that don't fit."""

    beam_ids: tuple[int, ...]
    grid: Grid = field(default_factory=Grid)
    nt_align: int = 0
    ring_capacity: int = 8
    telescoping: tuple[int, ...] = ()
    strict: bool = False
    accept_end_of_stream: bool = True
    packet_count_period_usec: int = 1_000_000
    max_packet_history: int = 3600

    def __post_init__(self):
        _check(bool(self.beam_ids), "there is no beam")
        _check(len(set(self.beam_ids)) == len(self.beam_ids), "a beam id is repeated")
        _check(all(0 <= b <= MAX_BEAM_ID for b in self.beam_ids), f"a beam id is not in 0..{MAX_BEAM_ID}")
        _check(self.nt_align >= 0 and self.nt_align % self.grid.nt_per_chunk == 0, "nt_align is not a multiple of the chunk's samples")
        _check(all(c >= 2 for c in self.capacities), "a ring capacity is below 2")

    @property
    def capacities(self) -> tuple[int, ...]:
        """Capacities of the levels; the first holds what waits for consumers and what is kept at full resolution."""
        first, rest = (self.telescoping[0], self.telescoping[1:]) if self.telescoping else (0, ())
        return (self.ring_capacity + first, *rest)

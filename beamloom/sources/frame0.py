"""The time of FPGA count 0, which a server tells as a JSON object with one whole number."""

from __future__ import annotations

import json
from urllib.request import urlopen

FIELD = "frame0_nano"


def parse_frame0(text: str) -> int:
    """Nanoseconds of count 0; an error where the text isn't a JSON object with a whole number there."""
    found = json.loads(text)
    value = found.get(FIELD) if isinstance(found, dict) else None
    if not isinstance(value, int) or isinstance(value, bool):
        raise ValueError(f"no whole number {FIELD} in {text[:200]!r}")
    return value


def fetch_frame0(url: str, seconds: float = 3.0) -> int:
    """One request of the driver; the number then goes into plans as a literal."""
    with urlopen(url, timeout=seconds) as answer:
        return parse_frame0(answer.read().decode())

"""Bloom filters over 64-bit hashes, split by hash into segments that are built by separate tasks."""

from __future__ import annotations

import numpy as np

from basketry.llm._text import U64, mix

BITS_PER_ITEM = 16
PROBES = 5
# A pair of filters has at most this many bits in each; above it more items pass, none is missed.
MAX_BITS = 1 << 28
SEGMENTS = 64


def bits_for(items: int, segments: int = SEGMENTS, max_bits: int = MAX_BITS) -> int:
    """Size of a segment's filter: a power of two, at least 1024 bits."""
    wanted = 1 << max(10, int(max(1, items * BITS_PER_ITEM) - 1).bit_length())
    return min(wanted, max(1024, max_bits // segments))


def segment_of(hashes: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    return (hashes >> U64(48)) % U64(segments)


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Positions of each hash in a segment of ``bits`` bits, one row per probe."""
    one, two = mix(hashes), mix(hashes ^ U64(0xA5A5A5A5A5A5A5A5)) | U64(1)
    with np.errstate(over="ignore"):
        return np.stack([((one + U64(k) * two) >> U64(20)) & U64(bits - 1) for k in range(PROBES)]).astype(np.int64)


def add(filter_: np.ndarray, hashes: np.ndarray) -> None:
    places = _places(hashes, len(filter_) * 8).ravel()
    np.bitwise_or.at(filter_, places >> 3, np.left_shift(1, places & 7).astype(np.uint8))


def has(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    places = _places(hashes, len(filter_) * 8)
    return ((filter_[places >> 3] >> (places & 7).astype(np.uint8)) & 1).all(axis=0)


def sightings(hashes: np.ndarray, filters: tuple[np.ndarray, np.ndarray], run: int = 1 << 18) -> None:
    """Note sightings in (once seen, twice seen): a hash found in the first goes to the second."""
    once, twice = filters
    for i in range(0, len(hashes), run):
        part, count = np.unique(hashes[i : i + run], return_counts=True)
        again = (count > 1) | has(once, part)
        add(twice, part[again])
        add(once, part)


class Segmented:
    """A whole filter, put together from its segments."""

    def __init__(self, parts: dict[int, bytes], segments: int = SEGMENTS):
        self.parts = {k: np.frombuffer(v, np.uint8) for k, v in parts.items()}
        self.segments = segments

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), bool)
        which = segment_of(hashes, self.segments)
        order = np.argsort(which, kind="stable")
        ends = np.searchsorted(which[order], np.arange(self.segments + 1).astype(U64))
        for k, part in self.parts.items():
            mine = order[ends[k] : ends[k + 1]]
            if len(mine):
                out[mine] = has(part, hashes[mine])
        return out

"""Words of many texts at once: their places and codes in numpy, hashes of runs of words, and bounded sieves of hashes.

Shared by the operators that look for runs of words (11, 12). All hashes only choose what is looked at closer: runs that
are equal have equal hashes, and what comes out is compared with the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are taken at once (a longer text is taken alone), and within which sums of powers run.
SLICE_BYTES, BLOCK_BYTES = 4 << 20, 1 << 19
#: A sieve has this many bits a hash, but not more than MOST_BITS in all (32 MB): beyond that it lets more pass.
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 1 << 16, 1 << 28

#: ASCII letters in lower case, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_TABLES: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of a base and of its inverse modulo 2^64."""
    size = 1 << max(12, n.bit_length())
    if (base, size) not in _TABLES:
        b = _BASES[base]
        up, down = np.full(size, b, np.uint64), np.full(size, pow(b, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _TABLES[base, size] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _TABLES[base, size]


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on all bits; different numbers stay different."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column without nulls, and where each begins (and the last ends)."""
    wide = column.cast(pa.large_string())
    _, places, data = wide.buffers()
    if not len(wide) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(wide) + 1, np.int64)
    cut = np.frombuffer(places, np.int64, len(wide) + 1, wide.offset * 8)
    return np.frombuffer(data, np.uint8)[cut[0] : cut[-1]], cut - cut[0]


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of about ``most`` bytes of text, of one row at least."""
    for batch in batches:
        if batch.num_rows:
            _, cut = text_bytes(batch.column(column))
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(cut, cut[at] + most, "right")) - 1)
                yield batch.slice(at, end - at)
                at = end


def word_places(data: np.ndarray, cut: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each maximal run of bytes that the table ``inside`` marks, within one text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    held = np.zeros(len(data) + 2, np.int8)
    held[1:-1] = inside[data]
    step = np.diff(held)
    inner = cut[(cut > 0) & (cut < len(data))]
    inner = np.unique(inner[(held[inner] == 1) & (held[inner + 1] == 1)])  # words that meet where two texts do
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if len(inner):
        start, end = np.sort(np.concatenate([start, inner])), np.sort(np.concatenate([end, inner]))
    return start, end


def word_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = 0) -> np.ndarray:
    """A 64-bit code of each word in lower case: a polynomial of its bytes, from differences of prefix sums. Codes of
    another ``base`` are independent."""
    codes = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + BLOCK_BYTES, "right")))
        low, n = int(start[at]), int(end[to - 1] - start[at])
        up, down = _powers(base, n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((LOWER[data[low : low + n]].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        a, b = start[at:to] - low, end[at:to] - low
        codes[at:to] = (sums[b] - sums[a]) * down[a]
        at = to
    return mixed(codes)


def run_codes(codes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit code of each run of ``size`` words: a polynomial of their codes, from differences of prefix sums."""
    n = len(codes)
    if n < size:
        return np.zeros(0, np.uint64)
    out, block = np.empty(n - size + 1, np.uint64), 1 << 18
    up, down = _powers(1, min(n, block + size))
    for at in range(0, n - size + 1, block):
        part = codes[at : at + block + size - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        many = len(part) - size + 1
        out[at : at + many] = (sums[size:] - sums[:-size]) * down[:many]
    return mixed(out + np.uint64(size))


class Sieve:
    """A Bloom filter of 64-bit hashes: has all that were put in, and few others while it is not full."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.mask = bits, np.uint64(len(bits) * 64 - 1)

    def has(self, codes: np.ndarray) -> np.ndarray:
        found = np.ones(len(codes), bool)
        for shift in (0, 32):
            at = (codes >> np.uint64(shift)) & self.mask
            found &= (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


def sieve_of(hashes: DataFrame, column: str, count: int) -> Sieve:
    """The sieve of a column of longs. Bits are united by Spark; the driver gets MOST_BITS of them at the most."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * max(1, count) - 1).bit_length()))
    h = F.col(column)
    places = F.explode(F.array(*[F.shiftrightunsigned(h, s).bitwiseAND(F.lit(size - 1)) if s else h.bitwiseAND(F.lit(size - 1)) for s in (0, 32)]))
    rows = hashes.select(places.alias("at")).groupBy(F.shiftright("at", 6).alias("word"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))
    found = rows.agg(F.bit_or(one).alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.uint64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return Sieve(bits)


def summed(hashes: list[np.ndarray], counts: list[np.ndarray], least: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, the sums of their counts and the smallest of their third values."""
    h, n, v = (np.concatenate(x) for x in (hashes, counts, least))
    order = np.argsort(h, kind="stable")
    h, n, v = h[order], n[order], v[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    return (h[first], np.add.reduceat(n, first), np.minimum.reduceat(v, first)) if len(first) else (h, n, v)

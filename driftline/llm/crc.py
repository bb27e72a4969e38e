"""CRC-32 of many byte spans at once, from a table of what a byte adds at each distance from its span's end.

A CRC is linear over XOR up to a constant that only the length decides: each byte of a
span adds its table value at its distance from the end, and the values of a span are
XORed by reduceat. A span longer than the table is folded block by block: the register is
moved on by a block's length of zero bytes and the block's own sum is XORed in.
"""

from __future__ import annotations

import numpy as np

#: Distances in the table: spans up to this length take one look.
SPAN = 64
#: Bytes of spans that are looked up at a time.
CHUNK = 1 << 20
# Fixed value: the reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1)
    return table


def _after_zero(register: np.ndarray) -> np.ndarray:
    return (register >> 8) ^ BYTE[register & 0xFF]


def _positions() -> np.ndarray:
    rows = [BYTE]
    for _ in range(SPAN - 1):
        rows.append(_after_zero(rows[-1]))
    return np.concatenate(rows)


def _starts() -> np.ndarray:
    register = np.array([0xFFFFFFFF], np.uint32)
    values = [register]
    for _ in range(SPAN):
        register = _after_zero(register)
        values.append(register)
    return np.concatenate(values)


def _skips() -> list[list[int]]:
    rows = []
    for k in range(4):
        register = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        for _ in range(SPAN):
            register = _after_zero(register)
        rows.append(register.tolist())
    return rows


BYTE = _byte_table()
#: What byte b adds at distance d from the end, at d * 256 + b.
POSITION = _positions()
#: The register, from its start, after so many zero bytes.
START = _starts()
#: The register after SPAN zero bytes, by each of its four bytes.
SKIP = _skips()


def _block_sums(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The XOR of the table values of each span of 1 to SPAN bytes."""
    first = np.cumsum(lengths) - lengths
    within = np.arange(int(first[-1] + lengths[-1])) - np.repeat(first, lengths)
    at = np.repeat(starts, lengths) + within
    distance = np.repeat(lengths - 1, lengths) - within
    return np.bitwise_xor.reduceat(POSITION[(distance << 8) + data[at]], first)


def _long_crc(data: np.ndarray, start: int, length: int) -> int:
    """The CRC of one span longer than SPAN; the short block comes first."""
    head = length % SPAN or SPAN
    register = int(START[head]) ^ int(_block_sums(data, np.array([start]), np.array([head]))[0])
    at, end = start + head, start + length
    a, b, c, d = SKIP
    while at < end:
        n = min(CHUNK, end - at) // SPAN
        sums = _block_sums(data, at + SPAN * np.arange(n), np.full(n, SPAN))
        for x in sums.tolist():
            register = a[register & 0xFF] ^ b[register >> 8 & 0xFF] ^ c[register >> 16 & 0xFF] ^ d[register >> 24] ^ x
        at += n * SPAN
    return register ^ 0xFFFFFFFF


def span_crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRC-32 of data[start : start + length] for each span, which may overlap; ``data`` is of uint8, no length is 0."""
    out = np.empty(len(starts), np.uint32)
    short = np.flatnonzero(lengths <= SPAN)
    ends = np.cumsum(lengths[short])
    at = 0
    while at < len(short):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        rows = short[at:upto]
        n = lengths[rows]
        out[rows] = _block_sums(data, starts[rows], n) ^ START[n] ^ np.uint32(0xFFFFFFFF)
        at = upto
    for i in np.flatnonzero(lengths > SPAN).tolist():
        out[i] = _long_crc(data, int(starts[i]), int(lengths[i]))
    return out

"""Static range asymmetric numeral system over integer ids, with many interleaved lanes.

A 64-bit state and 32-bit renormalisation: states lie in [2**31, 2**63), so a symbol moves at most one word.
Symbol ``i`` of a block belongs to lane ``i % LANES``; all lanes advance together, so that each step is a few
NumPy operations over the lanes. Blocks share a frequency table and depend on nothing else; each starts
with a checkpoint (its words' offset, the lanes' states) and has a checksum, so blocks decode in any order.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Frequencies of a table sum to 2**BITS.
BITS = 18
LANES = 1024
BLOCK = 1 << 19
_LOW = np.uint64(31)
_U = np.uint64


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to sum 2**BITS, at least 1 for each id that occurs."""
    total, used = int(counts.sum()), np.flatnonzero(counts)
    if not len(used):
        return np.zeros(len(counts), np.int64)
    if len(used) > 1 << BITS:
        raise ValueError("more distinct ids than a table has room for")
    freq = np.zeros(len(counts), np.int64)
    room = (1 << BITS) - len(used)
    freq[used] = 1 + counts[used].astype(np.int64) * room // total
    freq[used[np.argmax(counts[used])]] += (1 << BITS) - int(freq.sum())
    return freq


class Table:
    def __init__(self, freq: np.ndarray):
        self.freq = freq
        start = np.concatenate([[0], np.cumsum(freq)])
        self.start32 = start[:-1].astype(np.int64)
        self._lookup: np.ndarray | None = None

    @classmethod
    def of(cls, ids: np.ndarray, size: int) -> Table:
        return cls(frequencies(np.bincount(ids, minlength=size)))

    def dump(self) -> bytes:
        """Used ids as gaps, and their frequencies; deflated."""
        used = np.flatnonzero(self.freq)
        body = np.concatenate([[len(self.freq), len(used)], np.diff(used, prepend=0), self.freq[used]]).astype("<u4")
        return zlib.compress(body.tobytes(), 6)

    @classmethod
    def parse(cls, raw: bytes) -> Table:
        body = np.frombuffer(zlib.decompress(raw), "<u4").astype(np.int64)
        size, n = int(body[0]), int(body[1])
        freq = np.zeros(size, np.int64)
        freq[np.cumsum(body[2 : 2 + n])] = body[2 + n : 2 + 2 * n]
        return cls(freq)

    @property
    def lookup(self) -> np.ndarray:
        if self._lookup is None:
            self._lookup = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq)
        return self._lookup


def encode(ids: np.ndarray, table: Table) -> tuple[bytes, bytes, int]:
    """(states of the lanes, words, checksum of the ids) of one block."""
    ids = np.ascontiguousarray(ids)
    n, lanes = len(ids), min(LANES, max(1, len(ids)))
    f_all = table.freq[ids].astype(np.uint64)
    c_all = table.start32[ids].astype(np.uint64)
    limit = f_all << _U(63 - BITS)
    x = np.full(lanes, 1 << 31, np.uint64)
    words = []
    for at in range((n - 1) // lanes * lanes if n else -1, -1, -lanes):
        f, m = f_all[at : at + lanes], min(lanes, n - at)
        y = x[:m]
        over = y >= limit[at : at + lanes]
        out = y[over]
        words.append(out.astype(np.uint32))
        y[over] = out >> _U(32)
        q = y // f
        x[:m] = (q << _U(BITS)) + (y - q * f) + c_all[at : at + lanes]
    words.reverse()
    raw = np.concatenate(words).astype("<u4").tobytes() if words else b""
    return x.astype("<u8").tobytes(), raw, checksum(ids)


def decode(n: int, states: bytes, raw: bytes, table: Table) -> np.ndarray:
    x = np.frombuffer(states, "<u8").astype(np.uint64)
    words = np.frombuffer(raw, "<u4").astype(np.uint64)
    lanes, at_word = len(x), 0
    out = np.empty(n, np.uint32)
    lookup, mask = table.lookup, _U((1 << BITS) - 1)
    freq, start = table.freq.astype(np.uint64), table.start32.astype(np.uint64)
    for at in range(0, n, lanes):
        m = min(lanes, n - at)
        y = x[:m]
        slot = y & mask
        s = lookup[slot]
        out[at : at + m] = s
        y = freq[s] * (y >> _U(BITS)) + slot - start[s]
        under = y < _U(1 << 31)
        k = int(np.count_nonzero(under))
        if k:
            y[under] = (y[under] << _U(32)) | words[at_word : at_word + k]
            at_word += k
        x[:m] = y
    if at_word != len(words) or not (x == _U(1 << 31)).all():
        raise ValueError("a block of ids is damaged: its states don't return to the start")
    return out


def checksum(ids: np.ndarray) -> int:
    """crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())

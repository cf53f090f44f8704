"""Wavelet matrix of a token sequence in one compressed blob.

File format (little-endian): magic ``WVM1``; four u32: tokens n, distinct ids, levels, documents;
two u32: compressed sizes of the alphabet and of the document lengths; the alphabet
(sorted u32 ids, delta, zlib) and the document lengths (u32, zlib); then per level, from the most
significant bit of the ids' ranks: one u32 with the number of zeros, the bit plane (n bits, least
significant bit first, padded to 64), and the number of ones before every 512th bit (u32 each).
The planes hold ceil(log2(distinct ids)) bits a token. Access, counting and occurrence lookup
read the blob as it is.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, SAMPLE = b"WVM1", 512


def _unsplit(low: np.ndarray, high: np.ndarray, bit: np.ndarray) -> np.ndarray:
    out = np.empty(len(bit), dtype=np.uint16)
    out[~bit] = low
    out[bit] = high
    return out


def build(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """Blob of the ids of documents with the given lengths (ids below 2^32, at most 2^16 distinct)."""
    alphabet = np.unique(ids)
    if len(alphabet) > 1 << 16:
        raise ValueError("more than 65536 distinct ids in a shard")
    rank_of = np.zeros(int(alphabet[-1]) + 1 if len(alphabet) else 1, dtype=np.uint16)
    rank_of[alphabet] = np.arange(len(alphabet), dtype=np.uint16)
    seq = rank_of[ids]
    levels = max(1, int(len(alphabet) - 1).bit_length()) if len(alphabet) else 0
    a = zlib.compress(np.diff(alphabet, prepend=alphabet.dtype.type(0)).astype("<u4").tobytes(), 1)
    d = zlib.compress(np.asarray(lengths, dtype="<u4").tobytes(), 1)
    out = [MAGIC, struct.pack("<6I", len(ids), len(alphabet), levels, len(lengths), len(a), len(d)), a, d]
    for level in range(levels - 1, -1, -1):
        bit = (seq & np.uint16(1 << level)) != 0
        plane = np.packbits(bit, bitorder="little")
        plane = np.concatenate((plane, np.zeros(-len(plane) % 64, np.uint8)))
        ones = np.bitwise_count(plane.view("<u8")).reshape(-1, SAMPLE // 64).sum(axis=1)
        before = np.concatenate(([0], np.cumsum(ones))).astype("<u4")
        low = seq[~bit]
        out += [struct.pack("<I", len(low)), plane.tobytes(), before.tobytes()]
        seq = np.concatenate((low, seq[bit]))
    return b"".join(out)


class Wavelet:
    """Reader of a blob."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a token file")
        self.n, sigma, self.levels, docs, na, nd = struct.unpack_from("<6I", blob, 4)
        at = 28
        self.alphabet = np.cumsum(np.frombuffer(zlib.decompress(blob[at: at + na]), "<u4"), dtype=np.uint32)
        self.lengths = np.frombuffer(zlib.decompress(blob[at + na: at + na + nd]), "<u4")
        if len(self.alphabet) != sigma or len(self.lengths) != docs:
            raise ValueError("damaged token file")
        at += na + nd
        size = -(-self.n // SAMPLE) * (SAMPLE // 8)
        self.zeros, self.planes, self.before = [], [], []
        for _ in range(self.levels):
            self.zeros.append(struct.unpack_from("<I", blob, at)[0])
            self.planes.append(np.frombuffer(blob, np.uint8, size, at + 4))
            self.before.append(np.frombuffer(blob, "<u4", size * 8 // SAMPLE + 1, at + 4 + size))
            at += 4 + size + 4 * len(self.before[-1])

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // SAMPLE
        n = int(self.before[level][block])
        rest = self.planes[level][block * SAMPLE // 8: (i + 7) // 8]
        if len(rest):
            bits = np.unpackbits(rest, bitorder="little")[: i - block * SAMPLE]
            n += int(bits.sum())
        return n

    def access(self, i: int) -> int:
        """Id of token i."""
        code = 0
        for level in range(self.levels):
            bit = self.planes[level][i // 8] >> (i % 8) & 1
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            code = code * 2 + int(bit)
        return int(self.alphabet[code])

    def _path(self, token: int, i: int) -> tuple[int, int, list[int]]:
        """Range of the token's occurrences before position i on the last plane's order."""
        code = int(np.searchsorted(self.alphabet, token))
        if code >= len(self.alphabet) or self.alphabet[code] != token:
            return 0, 0, []
        a, b, bits = 0, i, []
        for level in range(self.levels):
            bit = code >> (self.levels - 1 - level) & 1
            x, y = self._ones(level, a), self._ones(level, b)
            a, b = (self.zeros[level] + x, self.zeros[level] + y) if bit else (a - x, b - y)
            bits.append(bit)
        return a, b, bits

    def rank(self, token: int, i: int | None = None) -> int:
        """Occurrences of an id among the first i tokens (all by default)."""
        a, b, _ = self._path(token, self.n if i is None else i)
        return b - a

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of an id."""
        a, b, bits = self._path(token, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        at = a + k
        for level in range(self.levels - 1, -1, -1):
            bit = bits[level]
            at = self._find(level, at - self.zeros[level] if bit else at, bit)
        return at

    def _find(self, level: int, k: int, bit: int) -> int:
        """Position of the k-th bit of the given value on a plane."""
        ones = self.before[level].astype(np.int64)
        count = ones if bit else np.minimum(np.arange(len(ones)) * SAMPLE, self.n) - ones
        block = int(np.searchsorted(count, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * SAMPLE // 8: (block + 1) * SAMPLE // 8], bitorder="little")
        return block * SAMPLE + int(np.flatnonzero(bits == bit)[k - int(count[block])])

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.rank(token))]

    def all(self) -> np.ndarray:
        """The whole sequence, undoing the planes from the last to the first."""
        seq = np.zeros(self.n, dtype=np.uint16)
        for level in range(self.levels - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            z = self.zeros[level]
            seq = _unsplit(seq[:z], seq[z:] | np.uint16(1 << (self.levels - 1 - level)), bit)
        return self.alphabet[seq] if self.n else np.empty(0, dtype=np.uint32)

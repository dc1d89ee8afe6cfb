"""Distinct word shingles of texts as sorted 64 bit hashes, for a whole batch at once with numpy.

A word's hash is a tabulation hash: the sum of one random number for each pair of a byte and its place, so that no
structure in the bytes cancels out. A shingle's hash mixes those of its words with odd factors of their own. Two given
shingles share a hash with a chance of 2**-64; hashers of different seeds share it independently.
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Places of a word with a random table of their own; further ones take mixed numbers.
PLACES = 64


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lower(data: np.ndarray) -> np.ndarray:
    """Bytes with a-z for A-Z."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


class Shingler:
    def __init__(self, k: int, seed: int = 0):
        rng = np.random.default_rng([20, seed])
        self.k, self.factors = k, rng.integers(1, 1 << 63, 2 * k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = rng.integers(1, 1 << 63, 1, dtype=np.uint64)[0]
        table = rng.integers(0, 1 << 64, (PLACES, 256), dtype=np.uint64)
        table[:, 65:91] = table[:, 97:123]
        self.table = table.ravel()

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all words, where each text's words end, and where each word begins and ends in the texts parted by blanks."""
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        blank = SPACE[data]
        edges = np.diff(np.concatenate([[True], blank]).view(np.int8))
        starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
        bounds = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        if not len(starts):
            return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64), starts, ends
        within = np.flatnonzero(~blank)
        lengths = ends - starts
        first = np.cumsum(lengths) - lengths
        place = np.arange(len(within)) - np.repeat(first, lengths)
        chars = data[within]
        far = place >= PLACES
        values = self.table[np.where(far, 0, place) * 256 + chars]
        if far.any():
            values[far] = mixed(mixed(place[far].astype(np.uint64) * np.uint64(256) + lower(chars[far])) ^ self.salt)
        return mixed(np.add.reduceat(values, first)), np.searchsorted(starts, bounds), starts, ends

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """Sorted distinct hashes of each text's shingles; a text of fewer than k words is one shingle, without words none."""
        hashes, ends, _, _ = self.words(texts)
        k, out, first = self.k, [], 0
        n = len(hashes) - k + 1
        rolled = np.zeros(max(0, n), np.uint64)
        for i in range(k):
            rolled += hashes[i : i + len(rolled)] * self.factors[i]
        rolled = mixed(rolled)
        for end in ends.tolist():
            if end - first >= k:
                out.append(np.unique(rolled[first : end - k + 1]))
            elif end > first:
                few = (hashes[first:end] * self.factors[k : k + end - first]).sum(dtype=np.uint64) + np.uint64(end - first)
                out.append(mixed(np.array([few], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
            first = end
        return out


def plain(text: bytes) -> bytes:
    """Its words in lower case, parted by single blanks. bytes.split() parts words at the same six bytes."""
    return b" ".join(lower(np.frombuffer(text, np.uint8)).tobytes().split())

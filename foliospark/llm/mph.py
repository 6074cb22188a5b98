"""Minimal perfect hashing of 64-bit keys by hash and displace, in numpy.

Keys fall into about n / 4 buckets. Buckets are placed by falling size: each gets the first displacement whose slots are
all free; buckets of one key take the slots that are left, stored as a negative number. A stored fingerprint of each key
makes a lookup of an unknown key fail but with probability 2**-32.
"""

from __future__ import annotations

import numpy as np

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31, _S32 = (np.uint64(x) for x in (30, 27, 31, 32))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x + _A).astype(np.uint64)
        x = (x ^ (x >> _S30)) * _B
        x = (x ^ (x >> _S27)) * _C
        return x ^ (x >> _S31)


class MinimalPerfectHash:
    """Maps n distinct 64-bit keys to 0 .. n - 1."""

    def __init__(self, n: int, displace: np.ndarray, fingerprints: np.ndarray):
        self.n, self.displace, self.fingerprints = n, displace, fingerprints

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalPerfectHash:
        keys = np.asarray(keys, dtype=np.uint64)
        n = len(keys)
        if n != len(np.unique(keys)):
            raise ValueError("keys must be distinct")
        buckets = max(1, n // 4)
        displace = np.zeros(buckets, np.int32)
        if n:
            hashed = mix(keys)
            owner = (hashed % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(owner, kind="stable")
            sizes = np.bincount(owner, minlength=buckets)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            free = np.ones(n, bool)
            single = []
            for b in np.argsort(-sizes, kind="stable"):
                size = sizes[b]
                if size == 0:
                    break
                own = hashed[order[starts[b] : starts[b + 1]]]
                if size == 1:
                    single.append(b)
                    continue
                d = 0
                while True:
                    tries = np.arange(d, d + 64, dtype=np.uint64)
                    slots = np.sort(cls._slot(own[None, :], tries[:, None], n), axis=1)
                    good = free[slots].all(axis=1) & (slots[:, 1:] != slots[:, :-1]).all(axis=1)
                    if good.any():
                        k = int(good.argmax())
                        free[slots[k]] = False
                        displace[b] = d + k
                        break
                    d += 64
            displace[np.array(single, np.int64)] = -1 - np.flatnonzero(free)[: len(single)]
        out = cls(n, displace, np.zeros(n, np.uint32))
        if n:
            out.fingerprints[out.slots(keys)] = cls.fingerprint(keys)
        return out

    @staticmethod
    def _slot(hashed, displacement, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(hashed ^ (displacement * _C)) % np.uint64(n)).astype(np.int64)

    @staticmethod
    def fingerprint(keys: np.ndarray) -> np.ndarray:
        return (mix(np.asarray(keys, np.uint64) ^ _B) >> _S32).astype(np.uint32)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; of a key that isn't in the table, any slot."""
        keys = np.asarray(keys, np.uint64)
        if not self.n:
            return np.full(len(keys), -1, np.int64)
        hashed = mix(keys)
        d = self.displace[(hashed % np.uint64(len(self.displace))).astype(np.int64)].astype(np.int64)
        return np.where(d < 0, -1 - d, self._slot(hashed, np.maximum(d, 0).astype(np.uint64), self.n))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key whose fingerprint agrees; -1 of others."""
        at = self.slots(keys)
        if not self.n:
            return at
        return np.where(self.fingerprints[at] == self.fingerprint(keys), at, -1)

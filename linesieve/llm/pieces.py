"""Encoded pieces of text, by number: each distinct piece is encoded once, while it is kept."""

from __future__ import annotations

import numpy as np


class Numbers(dict):
    """Pieces to numbers in order of appearance; fresh has those that came since it was last emptied."""

    def __init__(self, pieces: list[bytes] = ()):
        super().__init__((w, i) for i, w in enumerate(pieces))
        self.fresh: list[bytes] = []

    def __missing__(self, piece: bytes) -> int:
        self[piece] = n = len(self)
        self.fresh.append(piece)
        return n


class PieceStore:
    """Ids of numbered pieces in one flat array. Above keep pieces, the more used half of them stays."""

    def __init__(self, kind: np.dtype, keep: int):
        self.keep = keep
        self._hold([], np.zeros(0, kind), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _hold(self, pieces: list[bytes], flat: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> None:
        self.numbers = Numbers(pieces)
        self.flat, self.offsets, self.lengths, self.used = flat, offsets, lengths, np.zeros(len(pieces), np.int64)

    def shrink(self) -> None:
        if len(self.numbers) <= self.keep:
            return
        best = np.sort(np.argsort(-self.used, kind="stable")[: self.keep // 2])
        pieces = list(self.numbers)
        flat, ends = self.gather(best)
        n = self.lengths[best]
        self._hold([pieces[i] for i in best.tolist()], flat, ends - n, n)

    def ids_of(self, number: int) -> bytes:
        o = int(self.offsets[number])
        return self.flat[o : o + int(self.lengths[number])].tobytes()

    def add(self, encoded: list[bytes]) -> None:
        """The ids of numbers.fresh, in that order."""
        n = np.fromiter(map(len, encoded), np.int64, len(encoded)) // self.flat.itemsize
        self.offsets = np.concatenate([self.offsets, len(self.flat) + np.cumsum(n) - n])
        self.lengths = np.concatenate([self.lengths, n])
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(encoded), self.flat.dtype)])
        self.used = np.concatenate([self.used, np.zeros(len(n), np.int64)])
        self.numbers.fresh = []

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of numbered pieces in a row, and where each ends."""
        n = self.lengths[at]
        ends = np.cumsum(n)
        return self.flat[np.arange(int(n.sum())) + np.repeat(self.offsets[at] - (ends - n), n)], ends

    def count(self, at: np.ndarray) -> None:
        self.used += np.bincount(at, minlength=len(self.used))

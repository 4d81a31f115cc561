"""Numbers for the byte strings between white space, so that work on repeated words is done once in a worker."""

from __future__ import annotations

import numpy as np


class WordNumbers(dict):
    """word -> number, in order of first sight. ``fresh`` has the words seen since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.fresh.append(word)
        return number

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


class Ragged:
    """Growing list of unsigned 32-bit arrays, kept flat."""

    def __init__(self):
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at, self.n = np.zeros(1 << 14, np.int64), 0

    def extend(self, arrays: list) -> None:
        sizes = np.fromiter(map(len, arrays), np.int64, len(arrays))
        total = int(sizes.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(arrays) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        if total:
            self.flat[self.used : self.used + total] = np.fromiter((x for a in arrays for x in a), np.uint32, total)
        self.at[self.n + 1 : self.n + len(arrays) + 1] = self.used + np.cumsum(sizes)
        self.n, self.used = self.n + len(arrays), self.used + total

    def __getitem__(self, number: int) -> np.ndarray:
        return self.flat[self.at[number] : self.at[number + 1]]

    def gather(self, numbers: np.ndarray) -> np.ndarray:
        """The arrays of these numbers, one after another."""
        begin = self.at[numbers]
        sizes = self.at[numbers + 1] - begin
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(begin - (ends - sizes), sizes)]


def pieces_of(data: bytes, limit: int, space: bytes = b" \t\n\r\x0b\x0c"):
    """``data`` in parts of about ``limit`` bytes that end before white space, so that no word is cut."""
    start = 0
    while len(data) - start > limit:
        stop = max(data.rfind(bytes([c]), start + 1, start + limit) for c in space)
        if stop < 0:
            later = [x for c in space if (x := data.find(bytes([c]), start + limit)) >= 0]
            if not later:
                break
            stop = min(later)
        yield data[start:stop]
        start = stop
    yield data[start:]

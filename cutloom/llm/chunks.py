"""A bounded table of text chunks met before, with what they encode to in flat arrays."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

#: Bytes that a worker's table may take; a full table starts anew, results don't change.
MOST = 64 << 20
#: About what Python spends on an entry besides its text.
ENTRY = 150


# Fixed value: line end, printable ASCII and the letters of Latin-1, as bytes of that code.
_LATIN = bytes([10, *range(0x20, 0x7F), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])


def latin_rest(text: str) -> bytes:
    """What a text holds besides ASCII, line ends and the letters of Latin-1; something else if it can't be written so."""
    try:
        return text.encode("latin-1").translate(None, _LATIN)
    except UnicodeEncodeError:
        return b"?"


class Flat:
    """Pieces of one array, appended and gathered by their numbers."""

    def __init__(self, dtype: str):
        self.values, self.size, self.start = np.zeros(0, dtype), np.zeros(0, "i8"), np.zeros(0, "i8")

    def add(self, values: np.ndarray, size: np.ndarray) -> None:
        before = self.values.size
        self.start = np.concatenate([self.start, before + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.values = np.concatenate([self.values, values])

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of all places one after the other, where each place's end)."""
        size = self.size[places]
        ends = np.cumsum(size)
        total = int(ends[-1]) if ends.size else 0
        return self.values[np.arange(total) + np.repeat(self.start[places] - ends + size, size)], ends


class Table(dict):
    """Numbers of chunks.  What is missing gets the next number and waits in ``new`` for :meth:`learn`."""

    def __init__(self, learn: Callable[[list], list[tuple[np.ndarray, np.ndarray]]], dtypes: tuple[str, ...], most: int = MOST):
        super().__init__()
        self._learn, self._dtypes, self.most = learn, dtypes, most
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list = []
        self.held = 0
        self.flat = [Flat(d) for d in self._dtypes]

    def __missing__(self, chunk) -> int:
        self[chunk] = n = len(self)
        self.new.append(chunk)
        return n

    def places(self, parts: list[list]) -> np.ndarray:
        """The numbers of all chunks of ``parts``, all of which are known afterwards."""
        if self.held > self.most:
            self.forget()
        out = np.fromiter(map(self.__getitem__, chain.from_iterable(parts)), "i8", sum(map(len, parts)))
        if self.new:
            self.held += sum(map(len, self.new)) + ENTRY * len(self.new)
            for flat, (values, size) in zip(self.flat, self._learn(self.new), strict=True):
                flat.add(values, size)
                self.held += values.nbytes
            self.new = []
        return out

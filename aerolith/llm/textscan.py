"""Vectorised scanning of Arrow string columns.

Texts stay in Arrow's UTF-8 buffers; words are found and hashed with numpy over
a few megabytes at a time, so memory does not depend on how many or how long
the rows of an Arrow batch are (a single text is the least unit).

Word hashes are 64-bit: h(w) = sum T[w[k]] * B**k mod 2**64, with a random table
T and an odd B.  Lower-casing of A-Z is folded into T.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1


def _table() -> np.ndarray:
    t = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    t[ord("A") : ord("Z") + 1] = t[ord("a") : ord("z") + 1]
    return t


HASH_TABLE = _table()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: whitespace-delimited words: bytes other than 0x20 and 0x09-0x0D
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: alphanumeric words: 0-9, a-z, A-Z and every byte of a non-ASCII character
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: runs of letters: as ALNUM, without digits
LETTER = ALNUM.copy()
LETTER[0x30:0x3A] = False

_powers: dict[str, np.ndarray] = {}


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**k and B**-k for k < n at least."""
    have = _powers.get("n", 0)
    if have < n:
        size = 1 << max(21, int(n).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            out = np.empty(size, dtype=np.uint64)
            out[0] = 1
            filled, step = 1, base
            while filled < size:
                take = min(filled, size - filled)
                out[filled : filled + take] = out[:take] * np.uint64(step)
                step = step * step & _MASK
                filled += take
            _powers[name] = out
        _powers["n"] = size
    return _powers["up"], _powers["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a uint64 array."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Chunk:
    """Some whole texts of a batch: bytes and the bounds of each text."""

    def __init__(self, first: int, data: np.ndarray, bounds: np.ndarray):
        self.first, self.data, self.bounds = first, data, bounds
        self.rows = len(bounds) - 1

    def words(self, kind: np.ndarray) -> Words:
        return Words(self, kind)

    def text(self, row: int) -> str:
        return self.data[self.bounds[row] : self.bounds[row + 1]].tobytes().decode("utf-8", "replace")


class Words:
    """Maximal runs of the bytes in ``kind``; runs end with their text."""

    def __init__(self, chunk: Chunk, kind: np.ndarray):
        data, bounds = chunk.data, chunk.bounds
        self.chunk = chunk
        inside = kind[data]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        end = inside.copy()
        end[:-1] &= ~inside[1:]
        full = bounds[:-1] < bounds[1:]
        edge = bounds[:-1][full]
        begin[edge] = inside[edge]
        edge = bounds[1:][full] - 1
        end[edge] = inside[edge]
        self.start = np.flatnonzero(begin)
        self.stop = np.flatnonzero(end) + 1
        #: words of text r are those from of[r] up to of[r + 1]
        self.of = np.searchsorted(self.start, bounds)
        self._prefix: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def prefix(self) -> np.ndarray:
        if self._prefix is None:
            data = self.chunk.data
            up, _ = _pow(len(data) + 1)
            self._prefix = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum(HASH_TABLE[data] * up[: len(data)], out=self._prefix[1:])
        return self._prefix

    def hash(self, start: np.ndarray | None = None, stop: np.ndarray | None = None) -> np.ndarray:
        """Of the words, or of any byte ranges."""
        start = self.start if start is None else start
        stop = self.stop if stop is None else stop
        p = self.prefix
        _, down = _pow(len(p))
        return mix64((p[stop] - p[start]) * down[start])

    def text_of(self) -> np.ndarray:
        """The text's row for each word."""
        return np.repeat(np.arange(self.chunk.rows), np.diff(self.of))

    def counts(self) -> np.ndarray:
        return np.diff(self.of)


def hash_bytes(word: bytes) -> int:
    """The hash of one word, as ``Words.hash`` has it."""
    x = np.frombuffer(word, dtype=np.uint8)
    up, _ = _pow(len(x) + 1)
    total = (HASH_TABLE[x] * up[: len(x)]).sum(dtype=np.uint64)
    return int(mix64(np.array([total], dtype=np.uint64))[0])


def of_texts(texts: list[str | None]) -> Chunk:
    """All texts of a list as one chunk."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    bounds = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in raw], out=bounds[1:])
    return Chunk(0, np.frombuffer(b"".join(raw), dtype=np.uint8), bounds)


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string column into chunks of about ``most`` bytes.  A null counts as an empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(at, at[row] + most, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield Chunk(row, raw[at[row] : at[end]], at[row : end + 1] - at[row])
        row = end

"""Letter windows of many sequences at once, as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

U = np.uint64
_STEP = U(0x9E3779B97F4A7C15)


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(letters of all texts end to end, offsets in letters) of a text column without nulls.
    Letters are code points: bytes where all texts are ASCII, else 32-bit numbers."""
    column = column.cast(pa.large_string())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    if data.size and data.max() > 127:
        texts = column.to_pylist()
        return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum([0, *map(len, texts)])
    return data, off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them evenly."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def gear(data: np.ndarray, seed: int) -> np.ndarray:
    """The gear value of each letter: a random 64-bit number that depends on the letter only."""
    if data.dtype == np.uint8:
        return mix(np.arange(256, dtype=U) * _STEP + U(seed))[data]
    return mix(data.astype(U) * _STEP + U(seed))


def rolling(data: np.ndarray, width: int, shift: int, seed: int) -> np.ndarray:
    """Gear hash of the window of ``width`` letters that starts at each position: gear values
    are added up, each turned by ``shift`` bits against the next (turned, not dropped, so that
    windows of any width count in full). Windows are put together from halves by doubling."""
    part, size = gear(data, seed), 1
    out, done = None, 0
    left = width
    while left:
        if left & 1:
            if out is None:
                out, done = part, size
            else:
                m = max(0, len(data) - done - size + 1)
                out, done = _turn(out[:m], shift * size) + part[done : done + m], done + size
        left >>= 1
        if left:
            m = max(0, len(data) - 2 * size + 1)
            part, size = _turn(part[:m], shift * size) + part[size : size + m], 2 * size
    return out


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    by %= 64
    return (x << U(by)) | (x >> U(64 - by)) if by else x


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` entries, by doubling."""
    size = 1
    while 2 * size <= width:
        m = max(0, len(x) - size)
        x = np.minimum(x[:m], x[size : size + m])
        size *= 2
    if size < width:
        m = max(0, len(x) - (width - size))
        x = np.minimum(x[:m], x[width - size : width - size + m])
    return x


def inside(off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions where a window of ``width`` letters starts, without crossing from one text
    into the next; number of windows of each text)."""
    n = np.maximum(0, np.diff(off) - width + 1)
    first = np.repeat(off[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    return first + np.arange(n.sum()), n


def pieces(batches: Iterator[pa.RecordBatch], column: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a piece holds about ``most`` letters (a longer text alone)."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.cumsum(pa.compute.fill_null(pa.compute.utf8_length(b.column(column)), 0).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < b.num_rows:
            before = int(size[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(size, before + most, "right")))
            yield b.slice(begin, end - begin)
            begin = end


class Seen:
    """Ids met by a task, to leave out copies before the shuffle. Bounded: it starts afresh
    when full, which lets a copy through but loses nothing."""

    def __init__(self, most: int = 500_000):
        self.most, self.ids = most, set()

    def fresh(self, ids: list) -> list[int]:
        """Positions of the ids that weren't met before."""
        if len(self.ids) > self.most:
            self.ids.clear()
        out, seen = [], self.ids
        for i, x in enumerate(ids):
            if x not in seen:
                seen.add(x)
                out.append(i)
        return out

"""Near-duplicate records: all pairs of texts whose letter windows are similar enough.

1. Each distinct text gets min-hashes of its windows in bands of two, and a sketch of 128
   min-hashes: a fingerprint of 128 bits, one of each, so the distance of two fingerprints
   follows the similarity of the window sets, and a second bit of each. A band whose two windows
   are both hot (a large part of all texts has them) is told apart further by the text's least
   other window; a text that is hot for the most part keeps the plain band besides.
2. Keys are looked through first, without sketches: only rows whose key some other text has too
   go on (keys that a task meets often do so at once), and get their text's sketch then.
3. Rows (band key, sketch) are sorted by key. In a bucket the fingerprints are turned into
   bit planes, 64 of them to a word, and many distances grow at once in carry-save counters of
   whole words; a block is abandoned as soon as every lane is beyond the radius. Pairs within it
   must also agree in both bits of enough min-hashes. A key that comes up often in one task is
   packed into blocks there and never gathers; blocks of a key are spread over a grid of tasks,
   each holding the pairs of two groups of blocks. Pairs leave a task as they are found.
4. Pairs that are left are compared exactly on their window sets.

No bucket, partner or candidate is capped. A pair at similarity s shares a band with
probability 1 - (1 - s^2)^bands; with 32 bands that is 0.9999 at 0.5 and more above it. With
``exact`` the keys are the rarest windows of each text instead, so many that similar texts
must share one, and fingerprints turn nothing down: no pair is lost, at many times the cost.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociq.llm.windows import Seen, U, inside, letters, mix, pieces, rolling, sliding_min
from lociq.session import cut

BITS = 128
WORDS = BITS // 64
#: Words of a row: fingerprint, second bits, id of the text.
ROW = 2 * WORDS + 1
SLOTS = 1 << 22
_ALL = U(0xFFFFFFFFFFFFFFFF)


# --- sketches -------------------------------------------------------------------------


def codes(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """A number for each window of ``width`` letters: the letters themselves, a byte each, of
    windows of at most 8 plain letters; else a hash with the top bit set. Equal windows have
    equal numbers whatever stands around them."""
    if width <= 8 and data.dtype == np.uint8:
        whole = np.concatenate([data, np.zeros(8, np.uint8)])
        return np.ndarray(len(data), "<u8", whole, strides=(1,))[at] & U((1 << 8 * width) - 1)
    h = rolling(data, width, 13, 5)[at] | U(1 << 63)
    if width <= 8:
        plain = sliding_min((data < 128).astype(np.uint8), width)[at] == 1
        packed = np.zeros(len(at), U)
        for i in range(width):
            packed |= (data[at + i].astype(U) & U(0xFF)) << U(8 * i)
        h = np.where(plain, packed, h)
    return h


def window_hashes(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all windows, number of windows of each text)."""
    at, n = inside(off, width)
    return mix(codes(data, at, width)) if len(at) else np.zeros(0, U), n


def min_hashes(h: np.ndarray, n: np.ndarray, count: int) -> np.ndarray:
    """(texts, count) min-hashes of window hashes; every text must have a window."""
    base = (h >> U(32)).astype(np.uint32)
    out = np.empty((len(n), count), np.uint32)
    turn, factor = (mix(np.arange(count, dtype=U) + U(s)).astype(np.uint32) for s in (1000, 2_000_000))
    factor |= np.uint32(1)
    edges = np.concatenate([[0], np.cumsum(n)])
    begin = 0
    while begin < len(n):  # as many texts at a time as stay in the processor's cache
        end = max(begin + 1, int(np.searchsorted(edges, edges[begin] + 30_000, "right")) - 1)
        part, starts = base[edges[begin] : edges[end]], edges[begin:end] - edges[begin]
        v = np.empty_like(part)
        for i in range(count):
            np.bitwise_xor(part, turn[i], out=v)
            np.multiply(v, factor[i], out=v)
            out[begin:end, i] = np.minimum.reduceat(v, starts)
        begin = end
    return out


def fingerprints(least: np.ndarray) -> np.ndarray:
    """(texts, words) fingerprints: a bit for each min-hash, 64 to a word."""
    bits = ((least * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.uint8) & np.uint8(1)
    return np.packbits(bits, axis=1, bitorder="little").view(U)


def second_bits(least: np.ndarray) -> np.ndarray:
    """(texts, words) another bit of each min-hash, laid out as in fingerprints."""
    bits = ((least * np.uint32(0x9E3779B1)) >> np.uint32(23)).astype(np.uint8) & np.uint8(1)
    return np.packbits(bits, axis=1, bitorder="little").view(U)


def band_keys(least: np.ndarray, bands: int) -> np.ndarray:
    """(texts, bands) keys of two min-hashes each."""
    two = least[:, : 2 * bands].astype(U)
    return mix((two[:, ::2] << U(32) | two[:, 1::2]) + mix(np.arange(bands, dtype=U) + U(31)))


# --- bit-sliced comparison ------------------------------------------------------------


class Counters:
    """Vertical counters, one for each lane (bit of a word), fed with planes of one bit a lane.
    Planes of the same weight wait until three are there; a carry-save adder makes one of
    that weight and one of the next of them."""

    def __init__(self):
        self.waiting: list[list[np.ndarray]] = []

    def add(self, plane: np.ndarray, weight: int = 0) -> None:
        while True:
            if len(self.waiting) == weight:
                self.waiting.append([])
            w = self.waiting[weight]
            if len(w) < 2:
                w.append(plane)
                return
            a, b = w
            x = a ^ b
            carry = (a & b) | (x & plane)
            w[:] = [x ^ plane]
            plane, weight = carry, weight + 1

    def beyond(self, radius: int) -> np.ndarray:
        """A bit for each lane: whether its count is over ``radius``."""
        digits, carry = [], None
        for w in self.waiting:
            terms = [*w, *([carry] if carry is not None else [])]
            carry = None
            if len(terms) == 3:
                a, b, c = terms
                x = a ^ b
                digits.append(x ^ c)
                carry = (a & b) | (x & c)
            elif len(terms) == 2:
                digits.append(terms[0] ^ terms[1])
                carry = terms[0] & terms[1]
            else:
                digits.append(terms[0] if terms else None)
        digits.append(carry)
        over, same = None, None  # compared from the highest digit down
        for i in range(max(len(digits), radius.bit_length()) - 1, -1, -1):
            d = digits[i] if i < len(digits) else None
            if radius >> i & 1:
                if d is None:
                    return over if over is not None else self._none()
                same = d if same is None else same & d
            elif d is not None:
                hit = d if same is None else same & d
                over = hit if over is None else over | hit
                same = ~d if same is None else same & ~d
        return over if over is not None else self._none()

    def _none(self) -> np.ndarray:
        return np.zeros_like(next(p for w in self.waiting for p in w))


def _near_lanes(planes: Iterator[np.ndarray], radius: int) -> np.ndarray | None:
    """Lanes within the radius; None when the block was abandoned."""
    c = Counters()
    for i, p in enumerate(planes, 1):
        c.add(p)
        if i > radius and i % 32 == 0:
            over = c.beyond(radius)
            if (over == _ALL).all():
                return None
    return ~c.beyond(radius)


def planes_of(fp: np.ndarray) -> np.ndarray:
    """(BITS, words) bit planes of (members, WORDS) fingerprints, 64 members to a word."""
    lanes = -(-len(fp) // 64) * 64
    bits = np.zeros((BITS, lanes), np.uint8)
    bits[:, : len(fp)] = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8), axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view(U)


def _near_steps(left: np.ndarray, right: np.ndarray | None, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``near_pairs`` as they are found: of a million pairs at a time."""
    own = right is None
    right = left if own else right
    planes = planes_of(right)
    bits = np.unpackbits(np.ascontiguousarray(left).view(np.uint8), axis=1, bitorder="little").astype(bool)
    step = max(1, 16_384 // max(1, planes.shape[1]))
    for q in range(0, len(left), step):
        w0 = q // 64 if own else 0  # lanes before the queries are done already
        ask = np.where(bits[q : q + step], _ALL, U(0))
        near = _near_lanes((planes[b, None, w0:] ^ ask[:, b, None] for b in range(BITS)), radius)
        if near is None or not near.any():
            continue
        i, w = np.nonzero(near)
        lanes = np.unpackbits(near[i, w].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        k, lane = np.nonzero(lanes)
        i, j = i[k] + q, (w[k] + w0) * 64 + lane
        keep = (j < len(right)) & ((j > i) if own else True)
        yield i[keep], j[keep]


def _all_of(steps: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    z = np.zeros(0, np.int64)
    i, j = zip((z, z), *steps, strict=True)
    return np.concatenate(i), np.concatenate(j)


def near_pairs(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of fingerprints within the radius: of two blocks, or i < j of one."""
    return _all_of(_near_steps(left, right, radius))


def near_listed(fp: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> np.ndarray:
    """Which of the listed pairs are within the radius: lanes are pairs, of many small buckets."""
    keep = np.zeros(len(i), bool)
    for a in range(0, len(i), 65_536):
        s = slice(a, a + 65_536)
        planes = planes_of(fp[i[s]] ^ fp[j[s]])
        near = _near_lanes(iter(planes), radius)
        if near is not None:
            keep[s] = np.unpackbits(near.view(np.uint8), bitorder="little")[: len(keep[s])].astype(bool)
    return keep


def _bucket_steps(key: np.ndarray, fp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    edges = np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1, [len(key)]])
    size = np.diff(edges)
    for b in np.nonzero(size >= 64)[0]:
        for i, j in _near_steps(fp[edges[b] : edges[b + 1]], None, radius):
            yield i + edges[b], j + edges[b]
    small = size < 64
    # The pairs of a small bucket: each row with the 1st, 2nd, ... row after it.
    last = np.repeat(edges[1:], size)
    row = np.nonzero(np.repeat(small, size))[0]
    ahead = 1
    while len(row := row[row + ahead < last[row]]):
        ok = near_listed(fp, row, row + ahead, radius)
        yield row[ok], row[ok] + ahead
        ahead += 1


def _bucket_pairs(key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows within the radius, of all buckets (runs of equal keys) of a block."""
    return _all_of(_bucket_steps(key, fp, radius))


def _fp(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows[:, :WORDS])


def _alike(x: np.ndarray, y: np.ndarray, steps: Iterator[tuple[np.ndarray, np.ndarray]], unlike: int, most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """(a0, b0) of the pairs of rows whose min-hashes differ in at most ``unlike`` places by both
    bits, a0 < b0, a piece at a time. Rows of fingerprints alone are named by their first word."""
    plain = x.shape[1] == WORDS
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def piece():
        a, b = (np.concatenate(z) for z in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return pa.RecordBatch.from_arrays([pa.array(z[new].view(np.int64)) for z in (a, b)], names=["a0", "b0"])

    for i, j in steps:
        if plain:
            a, b = x[i, 0], y[j, 0]
        else:
            off = sum(np.bitwise_count((x[i, w] ^ y[j, w]) | (x[i, w + WORDS] ^ y[j, w + WORDS])).astype(np.int64) for w in range(WORDS))
            ok = off <= unlike
            a, b = x[i[ok], -1], y[j[ok], -1]
            ok = a != b
            a, b = a[ok], b[ok]
        if len(a):
            held.append((np.minimum(a, b), np.maximum(a, b)))
        if sum(len(a) for a, _ in held) >= most:
            yield piece()
    if held:
        yield piece()


# --- Spark stages ---------------------------------------------------------------------

_LONG = T.LongType()


def _fields(names: list[str]) -> list[T.StructField]:
    return [T.StructField(x, _LONG) for x in names]


def _columns(rows: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.ascontiguousarray(rows[:, i]).view(np.int64)) for i in range(rows.shape[1])]


def _rows_of(b: pa.RecordBatch, first: int) -> np.ndarray:
    return np.stack([b.column(first + i).to_numpy().view(U) for i in range(ROW)], axis=1)


def _texts(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, digest, text) of the rows that have at least one window."""
    t = F.col(text_col)
    rows = df.where(F.col(id_col).isNotNull() & (F.length(t) >= width))
    return rows.select(F.col(id_col).alias("id"), F.unhex(F.md5(t)).alias("digest"), t.alias("text"))


def _different(x: np.ndarray) -> np.ndarray:
    """The different numbers, sorted."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> U(20)).astype(np.int64) & (SLOTS - 1)


class _Counts:
    """How often each slot came up; slots are counted a few million at a time."""

    def __init__(self):
        self.count, self.held, self.size = np.zeros(SLOTS, np.int64), [], 0

    def add(self, slots: np.ndarray) -> None:
        self.held.append(slots)
        self.size += len(slots)
        if self.size >= 2_000_000:
            self.whole()

    def whole(self) -> np.ndarray:
        if self.held:
            self.count += np.bincount(np.concatenate(self.held), minlength=SLOTS)
            self.held, self.size = [], 0
        return self.count


def hot_slots(texts: DataFrame, width: int, share: float = 0.02, over: float = 4.0) -> tuple[np.ndarray, int]:
    """(hot windows, number of texts). Hot are windows that at least ``share`` of all texts have,
    as a table of hashed slots of a fixed size; a slot must besides be ``over`` times as full as
    an even spread makes it, so that long texts don't fill the table by chance.

    Counted exactly in two passes, whatever the layout: what has a share of all texts has that
    share in some task, so the first pass names every slot that may be hot, and the second
    counts the texts of these. At most a row a slot reaches the driver.
    """

    def local(batches):
        counts, docs, total = _Counts(), 0, 0
        for b in pieces(batches, 0, 500_000):
            h, n = window_hashes(*letters(b.column(0)), width)
            counts.add(_slot(h))
            docs, total = docs + len(n), total + len(h)
        if docs:
            count = counts.whole()
            at = np.nonzero(count >= max(1, share * docs))[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(np.zeros(len(at), np.int64), [docs, total]))], names=["slot", "n"])

    only = texts.select("text")
    t = only.mapInArrow(local, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    slot, n = t.column(0).to_numpy(), t.column(1).to_numpy()
    docs, total = int(n[slot == -1].sum()), int(n[slot == -2].sum())
    out = np.zeros(SLOTS, bool)
    out[slot[slot >= 0]] = True
    if not out.any():
        return out, docs
    sent = texts.sparkSession.sparkContext.broadcast(np.packbits(out))

    def exact(batches):
        may, counts = np.unpackbits(sent.value).astype(bool), _Counts()
        for b in pieces(batches, 0, 500_000):
            h, n = window_hashes(*letters(b.column(0)), width)
            at = _slot(h)
            keep = may[at]
            once = _different(np.repeat(np.arange(len(n)), n)[keep] * SLOTS + at[keep])
            counts.add(once & (SLOTS - 1))
        count = counts.whole()
        at = np.nonzero(count)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at])], names=["slot", "n"])

    t = only.mapInArrow(exact, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") >= F.lit(max(share * docs, over * total / SLOTS))).toArrow()
    out[:] = False
    out[t.column(0).to_numpy()] = True
    return out, docs


class _Packer:
    """Rows (key, sketch) of a task on their way out. Keys that come up ``often`` in one piece
    are packed into blocks of sketches; the others go on as plain rows. At most ``most`` rows
    are held at a time, of however many keys."""

    NAMES = ["part", *[f"f{i}" for i in range(ROW)], "fps"]

    def __init__(self, often: int, block: int, most: int = 500_000):
        self.often, self.block, self.most, self.serial = often, block, most, 0
        self.held: dict[int, list[np.ndarray]] = {}
        self.size: Counter[int] = Counter()

    def rows(self, key: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        kinds, of, n = np.unique(key, return_inverse=True, return_counts=True)
        many = n >= self.often
        if self.held:
            many |= np.isin(kinds, np.fromiter(self.held, U, len(self.held)))
        packed = many[of]
        yield self._plain(key[~packed], rows[~packed])
        if packed.any():
            order = np.argsort(of[packed], kind="stable")
            k, f = key[packed][order], rows[packed][order]
            edges = np.concatenate([[0], np.nonzero(k[1:] != k[:-1])[0] + 1, [len(k)]])
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                x = int(k[a])
                if x not in self.held:
                    self.held[x] = []
                    # An empty block tells the key's own task that there are blocks elsewhere.
                    yield self._block(x, x, np.zeros((0, ROW), U))
                self.held[x].append(f[a:b])
                self.size[x] += b - a
                if self.size[x] >= self.block:
                    yield from self._flush(x)
            if len(self.held) > 10_000 or self.size.total() > self.most:
                yield from self.rest()
                self.held.clear()
                self.size.clear()

    def rest(self) -> Iterator[pa.RecordBatch]:
        for x in list(self.held):
            yield from self._flush(x)

    def _flush(self, x: int) -> Iterator[pa.RecordBatch]:
        if self.held[x]:
            rows = np.concatenate(self.held[x])
            self.held[x], self.size[x] = [], 0
            for at in range(0, len(rows), self.block):
                self.serial += 1
                yield self._block(int(mix(np.array([x], U) + U(self.serial) + mix(rows[at : at + 1, -1]))[0]), x, rows[at : at + self.block])

    def _plain(self, key, rows) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *_columns(rows), pa.nulls(len(key), pa.binary())], names=self.NAMES)

    def _block(self, part: int, key: int, rows: np.ndarray) -> pa.RecordBatch:
        whole = np.concatenate([np.array([key], U), rows.ravel()]).tobytes()
        return pa.RecordBatch.from_arrays([pa.array(np.array([part], U).view(np.int64)), *[pa.nulls(1, pa.int64())] * ROW, pa.array([whole], pa.binary())], names=self.NAMES)


#: Kinds of packed rows: a text's key (5 bytes, the rest of it is the task's number) and id; id
#: and whole key of a row that goes on whoever else has the key; id and sketch of a text.
BAND, SURE, SKETCH = range(3)
ID_BYTES, KEY_BYTES = 6, 5
WIDTH = {BAND: KEY_BYTES + ID_BYTES, SURE: ID_BYTES + 8, SKETCH: ID_BYTES + 16 * WORDS}
_KEY_BITS = U(8 * KEY_BYTES)
#: In place of an id: the key was met often elsewhere, so all of its rows go on.
_OFTEN = U((1 << 8 * ID_BYTES) - 1)
_PARTS = "part int, kind int, rows binary"


def _packed(x: np.ndarray, size: int) -> np.ndarray:
    return np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(len(x), 8)[:, :size]


def _number(b: np.ndarray) -> np.ndarray:
    whole = np.zeros((len(b), 8), np.uint8)
    whole[:, : b.shape[1]] = b
    return whole.view("<u8").ravel()


def _ids(digests: pa.Array) -> np.ndarray:
    """The first six bytes of each digest as a number."""
    return _number(np.frombuffer(b"".join(digests.to_pylist()), np.uint8).reshape(-1, 16)[:, ID_BYTES - 1 :: -1])


class _Sorter:
    """Packed rows of a task, gathered by the task they go to: one binary for many of them."""

    def __init__(self, most: int = 400_000):
        self.most, self.size = most, 0
        self.held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def add(self, kind: int, part: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(part):
            self.held.setdefault(kind, []).append((part.astype(np.int32), np.concatenate(columns, axis=1)))
            self.size += len(part)
            if self.size >= self.most:
                yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        for kind, held in self.held.items():
            part, rows = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(part, kind="stable")
            part, rows = part[order], rows[order]
            edges = np.concatenate([[0], np.nonzero(part[1:] != part[:-1])[0] + 1, [len(part)]])
            blobs = [rows[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part[edges[:-1]]), pa.array(np.full(len(blobs), kind, np.int32)), pa.array(blobs, pa.binary())], names=["part", "kind", "rows"])
        self.held, self.size = {}, 0


def _keyed_rows(texts: DataFrame, width: int, keys, hot_table: np.ndarray, often: int, tasks: int) -> DataFrame:
    """(part, kind, rows): keys and sketches of all texts. ``keys`` makes (row, key) out of a
    piece's windows. Keys that come up often in a piece go to their text's task at once, and
    their own task is told so. Copies met by the same task go once."""
    sent = texts.sparkSession.sparkContext.broadcast(np.packbits(hot_table))

    def run(batches):
        seen, hot, out, told = Seen(), np.unpackbits(sent.value).astype(bool), _Sorter(), Seen()
        for b in pieces(batches, 1, 250_000):
            b = b.take(pa.array(seen.fresh(b.column(0).to_pylist()), pa.int64()))
            if not b.num_rows:
                continue
            h, n = window_hashes(*letters(b.column(1)), width)
            whole, id_ = min_hashes(h, n, BITS), _ids(b.column(0))
            row, key = keys(h, n, whole, hot[_slot(h)])
            part, own = (key >> _KEY_BITS) % U(tasks), id_ % U(tasks)
            kinds, first, of, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            sure = (count >= often)[of]
            yield from out.add(BAND, part[~sure], _packed(key[~sure], KEY_BYTES), _packed(id_[row[~sure]], ID_BYTES))
            if sure.any():
                local = key & ((U(1) << _KEY_BITS) - U(1))
                at = row[sure]
                yield from out.add(SURE, own[at], _packed(id_[at], ID_BYTES), _packed((part << _KEY_BITS | local)[sure], 8))
                kinds, first = kinds[count >= often], first[count >= often]
                new = told.fresh(kinds.tolist())
                yield from out.add(BAND, part[first[new]], _packed(kinds[new], KEY_BYTES), _packed(np.full(len(new), _OFTEN), ID_BYTES))
            sketch = np.concatenate([fingerprints(whole), second_bits(whole)], axis=1)
            yield from out.add(SKETCH, own, _packed(id_, ID_BYTES), np.ascontiguousarray(sketch).view(np.uint8))
        yield from out.rest()

    return texts.select("digest", "text").mapInArrow(run, _PARTS)


def _in_several(key: np.ndarray, id_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows (key, id), once each, whose key comes up with another id too."""
    order = np.argsort(key)
    key, id_ = key[order], id_[order]
    first = np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1])
    several = np.minimum.reduceat(id_, first) != np.maximum.reduceat(id_, first)
    keep = np.repeat(several, np.diff(np.append(first, len(key)))) & (id_ != _OFTEN)
    return _once(key[keep], id_[keep])


def _once(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs of numbers, sorted."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _met(keyed: DataFrame, tasks: int, most: int = 2_000_000) -> DataFrame:
    """Of the keyed rows those whose key another text has too, sent on to their text's task."""

    def run(batches):
        bands, total, out = [], 0, _Sorter()
        for b in batches:
            band = pa.compute.equal(b.column(1), BAND)
            for part, rows in zip(b.column(0).filter(band).to_pylist(), b.column(2).filter(band).to_pylist(), strict=True):
                bands.append((part, np.frombuffer(rows, np.uint8).reshape(-1, WIDTH[BAND])))
                total += len(bands[-1][1])
            yield b.filter(pa.compute.invert(band))
        passes = max(1, -(-total // most))
        for p in range(passes):  # a range of keys at a time
            keys, ids = [np.zeros(0, U)], [np.zeros(0, U)]
            for part, rows in bands:
                if passes > 1:
                    rows = rows[_number(rows[:, :KEY_BYTES]) * U(passes) >> _KEY_BITS == U(p)]
                keys.append(_number(rows[:, :KEY_BYTES]) | U(part) << _KEY_BITS)
                ids.append(_number(rows[:, KEY_BYTES:]))
            key, id_ = np.concatenate(keys), np.concatenate(ids)
            if len(key):
                key, id_ = _in_several(key, id_)
                yield from out.add(SURE, id_ % U(tasks), _packed(id_, ID_BYTES), _packed(key, 8))
        yield from out.rest()

    return keyed.repartitionById(tasks, "part").mapInArrow(run, _PARTS)


_ROWS = T.StructType([*_fields(_Packer.NAMES[:-1]), T.StructField("fps", T.BinaryType())])


def _with_sketches(met: DataFrame, tasks: int, often: int, block: int) -> DataFrame:
    """(part, sketch and id, fps): a row for each key of a text that another text has too, or
    blocks of rows of keys that come up often."""

    def run(batches):
        got = {SURE: [], SKETCH: []}
        for b in batches:
            for kind, rows in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                got[kind].append(rows)
        sure, sketch = (np.frombuffer(b"".join(got[k]), np.uint8).reshape(-1, WIDTH[k]) for k in (SURE, SKETCH))
        if not len(sure):
            return
        key, id_ = _once(_number(sure[:, ID_BYTES:]), _number(sure[:, :ID_BYTES]))
        known, first = np.unique(_number(sketch[:, :ID_BYTES]), return_index=True)
        words = np.ascontiguousarray(sketch[first, ID_BYTES:]).view("<u8")
        out = _Packer(often, block)
        for at in range(0, len(key), 65_536):
            k, i = key[at : at + 65_536], id_[at : at + 65_536]
            yield from out.rows(k, np.concatenate([words[np.searchsorted(known, i)], i[:, None]], axis=1))
        yield from out.rest()

    return met.repartitionById(tasks, "part").mapInArrow(run, _ROWS)


def _banded(bands: int, most_hot: float = 0.15):
    """Keys by bands of two min-hashes. Where both windows are hot, the band's first min-hash of
    the other windows is added, which pairs of which the hot part is small nearly always share
    too if they share the band; a text of which more than ``most_hot`` is hot keeps the plain
    key besides and meets its like there."""

    def keys(h, n, whole, is_hot):
        key, row = band_keys(whole, bands), np.repeat(np.arange(len(n)), bands)
        owner = np.repeat(np.arange(len(n)), n)
        n_hot = np.bincount(owner[is_hot], minlength=len(n))
        some = np.nonzero(n_hot)[0]
        if not len(some):
            return row, key.ravel()
        cold = np.full((len(some), 2 * bands), 0xFFFFFFFF, np.uint32)
        part = (n_hot > 0) & (n_hot < n)
        cold[part[some]] = min_hashes(h[~is_hot & part[owner]], (n - n_hot)[part], 2 * bands)
        by_hot = whole[some, : 2 * bands] < cold
        both = by_hot[:, ::2] & by_hot[:, 1::2]
        at, band = np.nonzero(both & (n_hot > most_hot * n)[some, None])
        plain = key[some[at], band]
        key[some] = np.where(both, mix(key[some] + mix(cold[:, ::2].astype(U) + U(77))), key[some])
        return np.concatenate([row, some[at]]), np.concatenate([key.ravel(), plain])

    return keys


def _prefixed(least: float):
    """Keys that no pair at ``least`` can miss: of the n windows of a text, in an order that is
    the same for all texts, the first n - ceil(least n) + 1. Hot windows come last in it."""

    def keys(h, n, whole, is_hot):
        owner = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((h, is_hot, owner))
        h, owner = h[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        h, owner = h[new], owner[new]
        size = np.bincount(owner, minlength=len(n))
        place = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
        take = place < (size - np.ceil(least * size - 1e-9) + 1)[owner]
        return owner[take], h[take]

    return keys


def _compare(rows: DataFrame, radius: int, unlike: int, block: int, tasks: int) -> DataFrame:
    """Pairs of all buckets: kind 0 are ids of pairs that are near enough (a0, b0); kind 1
    are blocks of a bucket that isn't finished in one task (key, fps)."""
    sorted_rows = rows.repartition(tasks, "part").sortWithinPartitions("part")
    names = ["kind", "a0", "b0", "key", "fps"]

    def pairs(key, fp):
        if len(key):
            for ab in _alike(fp, fp, _bucket_steps(key, _fp(fp), radius), unlike):
                n = ab.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), *ab.columns, pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names=names)

    def blocks(key, fp):
        none = pa.nulls(1, pa.int64())
        for at in range(0, len(fp), block):
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), none, none, pa.array([int(key)], pa.int64()), pa.array([fp[at : at + block].tobytes()], pa.binary())], names=names)

    def run(batches):
        key, fp = np.zeros(0, np.int64), np.zeros((0, ROW), U)
        open_ = None  # the bucket that is going out in blocks
        marked: set[int] = set()  # keys of this task with blocks elsewhere
        for b in chain(batches, [None]):
            if b is not None:
                packed = b.column(1 + ROW).is_valid()
                for x in b.column(1 + ROW).filter(packed).to_pylist():
                    own = np.frombuffer(x, U)
                    if len(own) == 1:
                        marked.add(int(own.view(np.int64)[0]))
                    else:
                        yield from blocks(own.view(np.int64)[0], own[1:].reshape(-1, ROW))
                plain = b.filter(pa.compute.invert(packed))
                key, fp = np.concatenate([key, plain.column(0).to_numpy()]), np.concatenate([fp, _rows_of(plain, 1)])
                if len(key) < block:
                    continue
            if not len(key):
                continue
            edges = np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1, [len(key)]])
            closed = len(edges) - (1 if b is None else 2)  # the last bucket may go on
            first = edges[:closed]
            big = np.diff(edges[: closed + 1]) > block
            if marked:
                big |= np.isin(key[first], np.fromiter(marked, np.int64, len(marked)))
            if open_ is not None and closed:
                big[0] |= key[0] == open_
            begin = 0
            for x in np.nonzero(big)[0]:
                yield from pairs(key[begin : edges[x]], fp[begin : edges[x]])
                yield from blocks(key[edges[x]], fp[edges[x] : edges[x + 1]])
                begin = edges[x + 1]
            yield from pairs(key[begin : edges[closed]], fp[begin : edges[closed]])
            key, fp = key[edges[closed] :], fp[edges[closed] :]
            while len(key) > block:
                open_ = key[0]
                yield from blocks(open_, fp[:block])
                key, fp = key[block:], fp[block:]

    schema = T.StructType([T.StructField("kind", T.IntegerType()), *_fields(["a0", "b0", "key"]), T.StructField("fps", T.BinaryType())])
    return sorted_rows.mapInArrow(run, schema)


#: Keys whose block counts may be broadcast (16 bytes each); beyond it they are joined by shuffle.
MOST_KEYS = 1_000_000


def _cell(x: np.ndarray, y: np.ndarray | None, radius: int, unlike: int) -> Iterator[pa.RecordBatch]:
    """Pairs of two groups of rows, or of one, in pieces of bounded size."""
    own = y is None
    y = x if own else y

    def steps():
        for s in range(0, len(x), 2048):
            for e in range(s if own else 0, len(y), 2048):
                for i, j in _near_steps(_fp(x[s : s + 2048]), None if own and s == e else _fp(y[e : e + 2048]), radius):
                    yield i + s, j + e

    return _alike(x, y, steps(), unlike)


def _compare_blocks(blocks: DataFrame, radius: int, group: int = 16, words: int = WORDS, unlike: int = BITS) -> DataFrame:
    """(a0, b0) of the buckets that were cut. A bucket's blocks fall into groups of about
    ``group`` by a hash; every two groups are a cell of a grid and a task of its own, so a block
    is sent once for each group of its bucket and not once for each other block. Rows are of
    ``words`` words."""
    n = blocks.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / group).cast("int").alias("groups"))
    few = n.limit(MOST_KEYS + 1).count() <= MOST_KEYS
    placed = blocks.select("key", "fps").join(F.broadcast(n) if few else n, "key").withColumn("own", F.pmod(F.xxhash64("fps"), F.col("groups")).cast("int"))
    cells = placed.select("key", "own", "fps", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("x")).select("key", F.least("own", "x").alias("row"), F.greatest("own", "x").alias("col"), "own", "fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, cell = {}, None
        for b in batches:
            own, row, col = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("own", "row", "col"))
            for o, f in zip(own, b.column(b.schema.get_field_index("fps")).to_pylist(), strict=True):
                sides.setdefault(o, []).append(f)
            cell = (row[0], col[0]) if row else cell
        if cell is None:
            return
        x, y = (np.frombuffer(b"".join(sides.get(g, [])), U).reshape(-1, words) for g in cell)
        yield from _cell(x, None if cell[0] == cell[1] else y, radius, unlike)

    return cells.groupBy("key", "row", "col").applyInArrow(run, "a0 long, b0 long")


def _similar(pairs: DataFrame, width: int, least: float) -> DataFrame:
    """(digest_a, digest_b, similarity) of the pairs that are at least ``least`` similar."""

    def distinct(b, c):
        """(row, window) of the different windows of a text column's rows, sorted."""
        data, off = letters(b.column(c))
        at, n = inside(off, width)
        owner, code = np.repeat(np.arange(len(n)), n), codes(data, at, width)
        if width <= 5 and data.dtype == np.uint8 and b.num_rows < 1 << 24:  # both in one number
            return _different(owner.astype(U) << U(40) | code), None
        order = np.lexsort((code, owner))
        owner, code = owner[order], code[order]
        new = np.ones(len(code), bool)
        new[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
        return owner[new], code[new]

    def common(b):
        """(windows in both, windows in either) of each row's texts."""
        (x, cx), (y, cy) = distinct(b, 1), distinct(b, 3)
        if cx is None and cy is None:
            z = np.sort(np.concatenate([x, y]))
            twice, owner = z[1:][z[1:] == z[:-1]] >> U(40), z >> U(40)
        else:
            if cx is None:
                x, cx = (x >> U(40)).astype(np.int64), x & U((1 << 40) - 1)
            if cy is None:
                y, cy = (y >> U(40)).astype(np.int64), y & U((1 << 40) - 1)
            owner, code = np.concatenate([x, y]), np.concatenate([cx, cy])
            order = np.lexsort((code, owner))
            owner, code = owner[order], code[order]
            twice = owner[1:][(code[1:] == code[:-1]) & (owner[1:] == owner[:-1])]
        both = np.bincount(twice.astype(np.int64), minlength=b.num_rows)
        return both, np.bincount(owner.astype(np.int64), minlength=b.num_rows) - both

    def run(batches):
        for whole in batches:
            for b in pieces(iter([whole]), 1, 250_000):
                both, either = common(b)
                at = pa.array(np.nonzero(both >= least * either)[0])
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), pa.array(both / either).take(at)], names=["digest_a", "digest_b", "similarity"])

    return pairs.select("digest_a", "text_a", "digest_b", "text_b").mapInArrow(run, "digest_a binary, digest_b binary, similarity double")


def class_links(df: DataFrame, id_col: str, text_col: str, width: int = 5, least: float = 0.5, bands: int = 32, block: int = 8_192, often: int = 64, exact: bool = False) -> DataFrame:
    """Links between different texts, once each: digest_a < digest_b, similarity.

    The similarity of two texts is the number of their common distinct windows of ``width``
    letters by that of all their windows. Rows with a null id or a text of fewer than ``width``
    letters (empty and null included) have no windows and no links. ``exact`` loses none.
    """
    # Four standard deviations of the distance at the limit: a false rejection in 30,000.
    mean = BITS * (1 - least) / 2
    radius = BITS if exact else int(mean + 4 * (mean * (1 - mean / BITS)) ** 0.5)
    texts = _texts(df, id_col, text_col, width)
    hot, n_texts = hot_slots(texts, width)
    # A false rejection by both bits in 300,000 at the limit (they differ in 3 of 4 places by chance).
    differ = 0.75 * (1 - least)
    unlike = BITS if exact else int(BITS * differ + 4.5 * (BITS * differ * (1 - differ)) ** 0.5)
    # About 16 MB of keys a task, however many texts there are.
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_texts * bands * WIDTH[BAND] // 16_000_000))
    met = _met(_keyed_rows(texts, width, _prefixed(least) if exact else _banded(bands), hot, often, tasks), tasks)
    found = cut(_compare(_with_sketches(met, tasks, often, block), radius, unlike, block, tasks))
    pairs = found.where("kind = 0").select("a0", "b0").unionByName(_compare_blocks(found.where("kind = 1"), radius, words=ROW, unlike=unlike))
    pairs = pairs.select(F.col("a0").alias("a"), F.col("b0").alias("b")).distinct()
    # Texts that share an id come out together and are told apart by the exact comparison.
    need = pairs.select(F.col("a").alias("f")).unionByName(pairs.select(F.col("b").alias("f"))).distinct()
    f = F.conv(F.hex(F.substring("digest", 1, ID_BYTES)), 16, 10).cast("long").alias("f")
    kept = cut(texts.select(f, "digest", "text").join(need, "f", "left_semi").dropDuplicates(["digest"]))
    a = kept.select(F.col("f").alias("a"), F.col("digest").alias("digest_a"), F.col("text").alias("text_a"))
    b = kept.select(F.col("f").alias("b"), F.col("digest").alias("digest_b"), F.col("text").alias("text_b"))
    with_text = pairs.join(a, "a").join(b, "b").where(F.col("digest_a") != F.col("digest_b"))
    s = _similar(with_text, width, least)
    low, high = F.least("digest_a", "digest_b"), F.greatest("digest_a", "digest_b")
    return s.select(low.alias("digest_a"), high.alias("digest_b"), "similarity").dropDuplicates(["digest_a", "digest_b"])


def members(df: DataFrame, id_col: str, text_col: str, width: int = 5) -> DataFrame:
    """(digest, id): which records have which text; a record listed twice counts once."""
    return _texts(df, id_col, text_col, width).select("digest", "id").distinct()


def near_duplicate_pairs(df: DataFrame, id_col: str, text_col: str, width: int = 5, least: float = 0.5, bands: int = 32, exact: bool = False) -> DataFrame:
    """All pairs of ids, a < b, whose texts are at least ``least`` similar, copies expanded.

    Null ids, and null, empty and shorter texts than a window, are in no pair; repeated rows
    count once; very long texts are compared whole; extra columns are ignored; an empty table
    gives no pairs.
    """
    links = cut(class_links(df, id_col, text_col, width, least, bands, exact=exact))
    m = cut(members(df, id_col, text_col, width))  # met four times below; texts are read once for it
    ma, mb = m.select(F.col("digest").alias("digest_a"), F.col("id").alias("x")), m.select(F.col("digest").alias("digest_b"), F.col("id").alias("y"))
    across = links.select("digest_a", "digest_b").join(ma, "digest_a").join(mb, "digest_b").select("x", "y")
    # Records of one and the same text; only texts with several records reach the self-join.
    several = m.groupBy("digest").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("digest")
    copies = m.join(several, "digest", "left_semi")
    same = copies.join(copies.select("digest", F.col("id").alias("y")), "digest").where(F.col("id") < F.col("y")).select(F.col("id").alias("x"), "y")
    both = across.unionByName(same).where(F.col("x") != F.col("y"))
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicate_groups(df: DataFrame, id_col: str, text_col: str, width: int = 5, least: float = 0.5, bands: int = 32, exact: bool = False) -> DataFrame:
    """One row per record with a window: id, class_id (the least id of records with the same
    text), group_id (the least class_id linked to it, directly or through others), links
    (texts linked directly to its own)."""
    m = cut(members(df, id_col, text_col, width))
    rep = m.groupBy("digest").agg(F.min("id").alias("class_id"))
    links = class_links(df, id_col, text_col, width, least, bands, exact=exact)
    ra, rb = rep.select(F.col("digest").alias("digest_a"), F.col("class_id").alias("a")), rep.select(F.col("digest").alias("digest_b"), F.col("class_id").alias("b"))
    edges = cut(links.join(ra, "digest_a").join(rb, "digest_b").select("a", "b"))
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("links"))
    root = components(edges)
    out = m.join(rep, "digest").join(degree.withColumnRenamed("a", "class_id"), "class_id", "left").join(root.select(F.col("node").alias("class_id"), "root"), "class_id", "left")
    return out.select("id", "class_id", F.coalesce("root", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component of edges (a, b).

    Large-star and small-star passes in turn, each a grouping by node with the least neighbour
    only, so a node of many edges combines on the map side. Lineage is cut after each pass.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = cut(small)
        if new.exceptAll(e).isEmpty() and e.exceptAll(new).isEmpty():
            break
        e = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()

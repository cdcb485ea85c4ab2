"""Overlapping and gapped intervals, without gathering an entity into one task.

Rows are range-sorted over the whole table by entity and start. Each partition is summed up
by its last entity, the furthest end of that entity and the start of its open stretch; the
summaries, one row a partition, are combined by prefix; a second pass over the sorted rows
carries the combined state in and labels islands. An entity may lie across any number of partitions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lociq.operators.ordered import breaks, ranged

LEAST = np.iinfo(np.int64).min


def _keys(batch: pa.RecordBatch, n: int) -> list[pa.Array]:
    return [batch.column(i) for i in range(n)]


def _scan(batches: Iterator[pa.RecordBatch], n_keys: int, state: tuple):
    """(batch, furthest end before each row or the least int64, label of each row's stretch,
    whether the row opens it, state) of each batch. The state, before the first row and after
    the last of a batch, is (entity, furthest end, start of the open stretch)."""
    entity, far, label = state
    for b in batches:
        if not b.num_rows:
            continue
        keys = _keys(b, n_keys)
        new = breaks(keys, b.num_rows)
        new[0] = tuple(k[0].as_py() for k in keys) != entity
        start, end = b.column(n_keys).to_numpy(), b.column(n_keys + 1).to_numpy()
        # One running maximum serves all entities of the batch: each is lifted over the last.
        group = np.cumsum(new) - (1 if new[0] else 0)
        low, high = int(min(end.min(), far if not new[0] else end.min())), int(max(end.max(), far if not new[0] else end.max()))
        width = high - low + 1
        lifted = end - low + group * width
        run = np.maximum.accumulate(lifted if new[0] else np.maximum(lifted, far - low))
        before = np.empty(len(end), np.int64)
        before[1:] = run[:-1] - group[1:] * width + low
        before[0] = far if not new[0] else LEAST
        before[new] = LEAST
        opens = (before == LEAST) | (start > before + 1)
        at = np.maximum.accumulate(np.where(opens, np.arange(len(start)), -1))
        labels = np.where(at >= 0, start[at], label)
        entity, far, label = tuple(k[-1].as_py() for k in keys), int(run[-1] - group[-1] * width + low), int(labels[-1])
        yield b, before, labels, opens, (entity, far, label)


def _prepare(df: DataFrame, by: Sequence[str], start: str, end: str) -> tuple[DataFrame, list[str]]:
    """Distinct intervals with ordered ends, sorted over all partitions, in the shared folder.
    The entity's columns go by names of their own inside, so none can clash."""
    s, e = F.col(start).cast("long"), F.col(end).cast("long")
    names = [f"__k{i}" for i in range(len(by))]
    rows = df.where(s.isNotNull() & e.isNotNull()).select(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], F.least(s, e).alias("__s"), F.greatest(s, e).alias("__e"))
    # The furthest end of equal starts stands for all of them: fewer rows, same stretches.
    rows = rows.groupBy(*names, "__s").agg(F.max("__e").alias("__e"))
    return ranged(rows, [*names, "__s"]), names


def _carried(rows: DataFrame, n: int) -> dict[int, tuple]:
    """State before each partition. One summary row a partition is fetched: the bound is the
    number of partitions, never the number of rows.

    A partition's last stretch opens where its own rows open it, unless the entity goes on from
    before and the end carried in reaches that far; then it is the stretch carried in."""
    fields = rows.schema.fields[:n]
    arrow = [to_arrow_type(f.dataType) for f in fields]
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), *[T.StructField(f"f{i}", f.dataType) for i, f in enumerate(fields)], *[T.StructField(f"l{i}", f.dataType) for i, f in enumerate(fields)],
        T.StructField("far", T.LongType()), T.StructField("label", T.LongType()), T.StructField("single", T.BooleanType()),
    ])

    def summary(batches):
        part, first, last, single = None, None, (None, 0, 0), True
        for b, before, _, _, state in _scan(batches, n, (None, 0, 0)):
            news = int((before == LEAST).sum())
            if part is None:
                part, first, news = b.column(n + 2)[0].as_py(), tuple(b.column(i)[0].as_py() for i in range(n)), news - 1
            single &= not news
            last = state
        if part is not None:
            values = [pa.array([v], t) for v, t in zip((*first, *last[0]), (*arrow, *arrow), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *values, pa.array([last[1]], pa.int64()), pa.array([last[2]], pa.int64()), pa.array([bool(single)])], names=schema.names)

    state, out = None, {}
    for r in sorted(rows.mapInArrow(summary, schema).collect(), key=lambda r: r["part"]):
        first, last, far, label = tuple(r[1 : 1 + n]), tuple(r[1 + n : 1 + 2 * n]), r["far"], r["label"]
        if state is not None:
            out[r["part"]] = state
        if r["single"] and state is not None and state[0] == first:
            label = label if label > state[1] + 1 else state[2]
            far = max(far, state[1])
        state = (last, far, label)
    return out


def _rescan(batches: Iterator[pa.RecordBatch], n: int, carried: dict[int, tuple]):
    """``_scan`` of a partition from the state that was carried up to it."""
    batches = iter(batches)
    head = next((b for b in batches if b.num_rows), None)
    if head is not None:
        yield from _scan(chain([head], batches), n, carried.get(head.column(n + 2)[0].as_py(), (None, 0, 0)))


def gaps(df: DataFrame, by: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Gaps of each entity: each longest run of positions between its first and last covered
    one that no interval covers. Columns: the entity's, gap_start, gap_end (both included).

    An interval covers all positions from the lower to the higher end, both included; one with
    a null end is left out. Null entities are entities of their own (nulls equal each other).
    Repeats change nothing. An empty table gives no gaps; other columns are ignored.
    """
    rows, names = _prepare(df, by, start, end)
    n, carried = len(by), _carried(rows, len(by))
    schema = T.StructType([*rows.schema.fields[:n], T.StructField("gap_start", T.LongType()), T.StructField("gap_end", T.LongType())])

    def find(batches):
        for b, before, _, opens, _ in _rescan(batches, n, carried):
            s = b.column(n).to_numpy()
            hit = np.nonzero(opens & (before != LEAST))[0]
            if len(hit):
                at = pa.array(hit)
                yield pa.RecordBatch.from_arrays([*[k.take(at) for k in _keys(b, n)], pa.array(before[hit] + 1), pa.array(s[hit] - 1)], names=schema.names)

    return rows.mapInArrow(find, schema).toDF(*by, "gap_start", "gap_end")


def islands(df: DataFrame, by: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Merged stretches of each entity: stretch_start, stretch_end, n_starts (intervals with a
    start of their own). Touching stretches (end + 1 = next start) are one. Cases as ``gaps``.

    A stretch may lie across partitions: the state carried up to a partition holds the start of
    the open stretch, which is its label, and pieces of one label are summed up.
    """
    rows, names = _prepare(df, by, start, end)
    n, carried = len(by), _carried(rows, len(by))
    schema = T.StructType([*rows.schema.fields[:n], *[T.StructField(x, T.LongType()) for x in ("__s", "__e", "__c")]])

    def pieces(batches):
        for b, _, labels, opens, _ in _rescan(batches, n, carried):
            e = b.column(n + 1).to_numpy()
            first = np.nonzero(np.append(True, opens[1:]))[0]
            at = pa.array(first)
            yield pa.RecordBatch.from_arrays([*[k.take(at) for k in _keys(b, n)], pa.array(labels[first]), pa.array(np.maximum.reduceat(e, first)), pa.array(np.diff(np.append(first, len(e))))], names=schema.names)

    p = rows.mapInArrow(pieces, schema).groupBy(*names, "__s").agg(F.max("__e").alias("__e"), F.sum("__c").alias("__c"))
    return p.toDF(*by, "stretch_start", "stretch_end", "n_starts")

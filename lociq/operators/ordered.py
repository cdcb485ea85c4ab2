"""Numbering rows in order without gathering a group into one task.

Rows are range-sorted over the whole table by group and order, so a group may lie across any
number of partitions. Each partition is summed up by its first and last group and how many rows
of the last it holds; the summaries, one row a partition, are combined by prefix; a second pass
numbers the rows from where the partitions before left off.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lociq.session import cut

PART = "__part"


def breaks(keys: Sequence[pa.Array], n: int) -> np.ndarray:
    """True where a row's group differs from the row before; the first row is True."""
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        code = k.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return new


def ranged(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows range-sorted by ``order`` over all partitions, in the shared folder, with the
    number of their partition in ``PART``."""
    return cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(PART, F.spark_partition_id()))


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "place") -> DataFrame:
    """The rows with their number within their group ``by`` (all rows, if it is empty), from 1
    on, by ``order``; nulls come first and make a group of their own.

    Rows of equal order get different numbers, in any order. What reaches the driver is a row
    a partition. An empty table gives no rows; a column called ``name`` is replaced.
    """
    rest = [c for c in df.columns if c not in by and c != name]
    rows = ranged(df.select(*by, *rest), [*by, *order])
    n, fields = len(by), [rows.schema[c] for c in by]
    arrow = [to_arrow_type(f.dataType) for f in fields]
    edge = lambda b, i: tuple(b.column(k)[i].as_py() for k in range(n))
    summary = T.StructType([
        T.StructField("part", T.IntegerType()), *[T.StructField(f"{x}{i}", f.dataType) for x in "fl" for i, f in enumerate(fields)], T.StructField("n", T.LongType()), T.StructField("single", T.BooleanType()),
    ])

    def number(batches, key, count):
        for b in batches:
            if b.num_rows:
                new = breaks([b.column(i) for i in range(n)], b.num_rows)
                new[0] = edge(b, 0) != key
                at = np.arange(b.num_rows)
                begin = np.maximum.accumulate(np.where(new, at, -1))
                value = np.where(begin >= 0, at - begin + 1, count + at + 1)
                key, count = edge(b, -1), int(value[-1])
                yield b, new, value

    def sum_up(batches):
        part, first, last, count, single = None, (), (), 0, True
        for b, new, value in number(batches, None, 0):
            if part is None:
                part, first = b.column(b.num_columns - 1)[0].as_py(), edge(b, 0)
                single = not new[1:].any()
            else:
                single &= not new.any()
            last, count = edge(b, -1), int(value[-1])
        if part is not None:
            values = [pa.array([v], t) for v, t in zip((*first, *last), (*arrow, *arrow), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *values, pa.array([count], pa.int64()), pa.array([bool(single)])], names=summary.names)

    keys = rows.select(*by, PART)
    state, before = None, {}
    for r in sorted(keys.mapInArrow(sum_up, summary).collect(), key=lambda r: r["part"]):
        first, last = tuple(r[1 : 1 + n]), tuple(r[1 + n : 1 + 2 * n])
        if state is not None:
            before[r["part"]] = state
        more = state[1] if r["single"] and state is not None and state[0] == first else 0
        state = (last, r["n"] + more)
    width = len(rows.columns) - 1

    def give(batches):
        batches = iter(batches)
        head = next((b for b in batches if b.num_rows), None)
        if head is None:
            return
        key, count = before.get(head.column(width)[0].as_py(), (None, 0))

        def whole():
            yield head
            yield from batches

        for b, _, value in number(whole(), key, count):
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(width)], pa.array(value.astype(np.int32))], names=out.names)

    out = T.StructType([*[rows.schema[c] for c in rows.columns[:-1]], T.StructField(name, T.IntegerType())])
    return rows.mapInArrow(give, out)

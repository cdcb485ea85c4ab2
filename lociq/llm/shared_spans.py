"""Long exact spans shared between records.

Content-defined chunking: a gear rolling hash runs over each text; of the 12-letter windows
inside every span of ``least`` letters the one with the lowest hash is its anchor. Spans
with the same anchor run on side by side and make one variable chunk, cut where the anchor
changes. Anchors depend on the letters of the span alone, so an insertion moves chunks but
doesn't change them, and equal spans always have equal anchors.

1. (anchor digest, text, place) is sorted by anchor; an anchor of a single text is dropped,
   and with it the bulk of the corpus, before any letter is shuffled. Where a task itself sees
   several texts with an anchor, only its first and last row go to the anchor's task, with the
   number of the others; those are known to be shared and are spread evenly.
2. The letters of the remaining chunks are fetched and sorted by anchor; the spans in chunks of
   one anchor are deduplicated by digest. A span digest that two texts have is shared.
3. An anchor of ``hot`` chunks or more never gathers: its spans go on one by one, as digests
   of 128 bits that are grouped with the least and greatest text, which combines.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociq.llm.windows import Seen, U, inside, letters, mix, pieces, rolling, sliding_min
from lociq.session import cut

ANCHOR = 12  # letters of an anchor; five bits of turn each
SLOTS = 1 << 22
_KNOWN = np.int64(1) << np.int64(62)


def _slot(anchor: np.ndarray) -> np.ndarray:
    return (mix(anchor.view(U)) & U(SLOTS - 1)).astype(np.int64)


def chunk(data: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of all texts: (text number, first span's place in the whole, number of spans,
    anchor digest)."""
    at, n = inside(off, least)
    if not len(at):
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, U)
    k = min(ANCHOR, least)
    h = mix(rolling(data, k, 5, 3))
    # Place in the low half: of equal hashes the left one is the anchor, wherever the batch begins.
    low = U(0xFFFFFFFF)
    ranked = (h & ~low) | np.arange(len(h), dtype=U)
    anchor = (sliding_min(ranked, least - k + 1)[at] & low).astype(np.int64)
    owner = np.repeat(np.arange(len(n)), n)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    first = np.nonzero(new)[0]
    return owner[first], at[first], np.diff(np.append(first, len(at))), h[anchor[first]]


def _texts(df: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(id, s, t, text): s and t are the 128 bits that tell a text from others."""
    x = F.col(text_col)
    return df.where(F.col(id_col).isNotNull() & (F.length(x) >= least)).select(F.col(id_col).alias("id"), F.xxhash64(x).alias("s"), F.xxhash64(F.lit(1), x).alias("t"), x.alias("text"))


def _once():
    """Pieces of (s, t, text, ...) batches without the copies that the task has met."""

    def run(batches):
        seen = Seen()
        for b in pieces(batches, 2):
            yield b.take(pa.array(seen.fresh(list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))), pa.int64()))

    return run


def _anchor_rows(texts: DataFrame, least: int) -> DataFrame:
    """(part, s, t, place): place holds the first span's start and the number of spans. Rows of
    an anchor lie under its digest; those known to be shared under a number of their own, and
    how many they are is told to the anchor by a row of a negative place."""
    once = _once()

    def run(batches):
        for b in once(batches):
            if not b.num_rows:
                continue
            data, off = letters(b.column(2))
            owner, at, n, anchor = chunk(data, off, least)
            if not len(owner):
                continue
            order = np.argsort(anchor, kind="stable")
            anchor, owner, place = anchor[order], owner[order], ((at - off[owner]) << 16 | n)[order]
            new = np.ones(len(anchor), bool)
            new[1:] = anchor[1:] != anchor[:-1]
            edges = np.append(np.nonzero(new)[0], len(anchor))
            varied = owner[edges[:-1]] != owner[edges[1:] - 1]
            known = np.repeat(varied, np.diff(edges))
            known[edges[:-1]] = known[edges[1:] - 1] = False
            rest = np.add.reduceat(known, edges[:-1])
            tell = np.nonzero(rest)[0]
            s, t = b.column(0).to_numpy()[owner], b.column(1).to_numpy()[owner]
            part = np.where(known, mix(s.view(U) ^ mix(place.view(U))), anchor).view(np.int64)
            zero = np.zeros(len(tell), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in ((part, anchor[edges[tell]].view(np.int64)), (s, zero), (t, zero), (np.where(known, place | _KNOWN, place), -rest[tell]))], names=["part", "s", "t", "place"]
            )

    return texts.select("s", "t", "text").mapInArrow(run, "part long, s long, t long, place long")


def _several(rows: DataFrame, hot: int) -> DataFrame:
    """(s, t, place, slot): the rows whose anchor more than one text has, and a slot for each
    anchor of at least ``hot`` rows. Rows come sorted by anchor and text; only the rows of an
    anchor's first text wait, the others pass through."""
    ordered = rows.repartition("part").sortWithinPartitions("part", "s", "t")
    names = ["s", "t", "place", "slot"]

    def out(s, t, place):
        return pa.RecordBatch.from_arrays([pa.array(s), pa.array(t), pa.array(place), pa.nulls(len(s), pa.int64())], names=names)

    def run(batches):
        anchor = s = t = place = np.zeros(0, np.int64)
        passed, gone = None, 0  # the anchor, still open, of several texts, and how many of its rows are out
        for b in chain(batches, [None]):
            if b is not None:
                new = [b.column(i).to_numpy() for i in range(4)]
                known = (new[3] > 0) & (new[3] & _KNOWN != 0)
                if known.any():
                    yield out(new[1][known], new[2][known], new[3][known] & ~_KNOWN)
                anchor, s, t, place = (np.concatenate([x, y[~known]]) for x, y in zip((anchor, s, t, place), new, strict=True))
            if not len(anchor):
                continue
            edges = np.concatenate([[0], np.nonzero(anchor[1:] != anchor[:-1])[0] + 1, [len(anchor)]])
            first, last = edges[:-1], edges[1:] - 1
            size = np.add.reduceat(np.where(place < 0, -place, 1), first)
            # Sorted: first against last. A row of a number comes from a task that saw several.
            varied = (s[first] != s[last]) | (t[first] != t[last]) | (np.minimum.reduceat(place, first) < 0)
            if anchor[0] == passed:
                varied[0] = True
                size[0] += gone
            more = b is not None  # the last anchor may go on
            passed, gone = (anchor[-1], int(size[-1])) if more and varied[-1] else (None, 0)
            heavy = first[: len(first) - more][size[: len(size) - more] >= hot]
            if len(heavy):
                none = pa.nulls(len(heavy), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, pa.array(_slot(anchor[heavy]))], names=names)
            keep = np.repeat(varied, np.diff(edges)) & (place >= 0)
            stop = len(anchor) if not more or varied[-1] else int(edges[-2])
            keep = keep[:stop]
            yield out(s[:stop][keep], t[:stop][keep], place[:stop][keep])
            anchor, s, t, place = anchor[stop:], s[stop:], t[stop:], place[stop:]

    return ordered.mapInArrow(run, "s long, t long, place long, slot long")


def _chunk_rows(texts: DataFrame, shared: DataFrame, hot_table: np.ndarray, least: int) -> DataFrame:
    """(part, s, t, start, letters, h1, h2): the chunks that are left under their anchor; of hot
    anchors the digests of their spans, each under its own first half."""
    per_text = shared.groupBy("s", "t").agg(F.collect_set("place").alias("places"))
    once = _once()
    fetched = texts.select("s", "t", "text").mapInArrow(once, "s long, t long, text string").join(per_text, ["s", "t"])
    sent = texts.sparkSession.sparkContext.broadcast(np.packbits(hot_table))
    names = ["part", "s", "t", "start", "letters", "h1", "h2"]

    def run(batches):
        hot = np.unpackbits(sent.value).astype(bool)
        for b in pieces(batches, 2):
            data, off = letters(b.column(2))
            owner, at, n, anchor = chunk(data, off, least)
            wanted, s, t = b.column(3), b.column(0).to_numpy(), b.column(1).to_numpy()
            who = np.repeat(np.arange(b.num_rows), pa.compute.list_value_length(wanted).to_numpy())
            have, want = _code(owner, (at - off[owner]) << 16 | n), _code(who, wanted.flatten().to_numpy())
            chosen = np.isin(have, want)
            heavy = hot[_slot(anchor)]
            keep = np.nonzero(chosen & ~heavy)[0]
            start, size = (at - off[owner])[keep], (n + least - 1)[keep]
            if data.dtype == np.uint8:
                edge = np.concatenate([[0], np.cumsum(size)])
                pick = np.repeat(at[keep] - edge[:-1], size) + np.arange(edge[-1])
                body = pa.StringArray.from_buffers(len(keep), pa.py_buffer(edge.astype(np.int32).tobytes()), pa.py_buffer(data[pick].tobytes()))
            else:
                whole = b.column(2).to_pylist()
                body = pa.array([whole[o][x : x + z] for o, x, z in zip(owner[keep].tolist(), start.tolist(), size.tolist(), strict=True)], pa.string())
            none = pa.nulls(len(keep), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(anchor[keep].view(np.int64)), pa.array(s[owner[keep]]), pa.array(t[owner[keep]]), pa.array(start), body, none, none], names=names)
            rest = np.nonzero(chosen & heavy)[0]
            if len(rest):
                x = np.repeat(owner[rest], n[rest])
                place = np.repeat(at[rest] - np.cumsum(n[rest]) + n[rest], n[rest]) + np.arange(n[rest].sum())
                h1, h2 = (mix(rolling(data, least, *seed)[place]).view(np.int64) for seed in ((1, 9), (7, 21)))
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(s[x]), pa.array(t[x]), pa.array(place - off[x]), pa.nulls(len(x), pa.string()), pa.array(h1), pa.array(h2)], names=names)

    return fetched.mapInArrow(run, "part long, s long, t long, start long, letters string, h1 long, h2 long")


def _code(owner: np.ndarray, place: np.ndarray) -> np.ndarray:
    return mix(mix(owner.astype(U)) + place.astype(U))


def _span_rows(chunks: DataFrame, least: int) -> DataFrame:
    """kind 0: (s, t, a, b) runs of shared letters; kind 1: spans of hot anchors (s, t, a, h1, h2).
    Chunks come sorted by anchor; a task holds those of one anchor, fewer than ``hot``, and a batch."""
    ordered = chunks.repartition("part").sortWithinPartitions("part")
    names = ["kind", "s", "t", "a", "b", "h1", "h2"]

    def finish(anchor, s, t, start, body):
        data, off = letters(body)
        at, n = inside(off, least)
        owner = np.repeat(np.arange(len(n)), n)
        # Equal spans lie under equal anchors, so a digest is only compared within its anchor.
        h = mix(rolling(data, least, 1, 9)[at]) ^ mix(anchor.view(U))[owner]
        order = np.argsort(h, kind="stable")
        hs = h[order]
        edges = np.concatenate([[0], np.nonzero(hs[1:] != hs[:-1])[0] + 1])
        several = np.zeros(len(edges), bool)
        for x in (s, t):
            w = x[owner][order]
            several |= np.minimum.reduceat(w, edges) != np.maximum.reduceat(w, edges)
        shared = np.zeros(len(h), bool)
        shared[order] = np.repeat(several, np.diff(np.append(edges, len(h))))
        if not shared.any():
            return
        p = np.nonzero(shared)[0]
        new = np.ones(len(p), bool)
        new[1:] = (p[1:] != p[:-1] + 1) | (owner[p[1:]] != owner[p[:-1]])
        first = np.nonzero(new)[0]
        last = np.append(first[1:], len(p)) - 1
        place = start[owner] + at - off[owner]
        who, none = owner[p[first]], pa.nulls(len(first), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(first), np.int32)), pa.array(s[who]), pa.array(t[who]), pa.array(place[p[first]]), pa.array(place[p[last]] + least - 1), none, none], names=names)

    def run(batches):
        held, rows = [], 0
        for b in chain(batches, [None]):
            if b is not None:
                single = b.column(4).is_null()
                x = b.filter(single)
                if x.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.ones(x.num_rows, np.int32)), x.column(1), x.column(2), x.column(3), pa.nulls(x.num_rows, pa.int64()), x.column(5), x.column(6)], names=names)
                    b = b.filter(pa.compute.invert(single))
                if b.num_rows:
                    held.append(b)
                    rows += b.num_rows
                if rows < 50_000:
                    continue
            if not rows:
                continue
            whole = pa.Table.from_batches(held).combine_chunks()
            anchor, s, t, start = (whole.column(i).to_numpy() for i in range(4))
            # The last anchor may go on.
            stop = len(anchor) if b is None else int(np.searchsorted(anchor, anchor[-1], "left"))
            if stop:
                yield from finish(anchor[:stop], s[:stop], t[:stop], start[:stop], pa.concat_arrays(whole.column(4).chunks).slice(0, stop))
            held = [x for x in whole.slice(stop).to_batches() if x.num_rows]
            rows = len(anchor) - stop

    return ordered.mapInArrow(run, "kind int, s long, t long, a long, b long, h1 long, h2 long")


def shared_runs(df: DataFrame, id_col: str, text_col: str, least: int = 40, hot: int = 60_000) -> DataFrame:
    """(id, span_start, span_end): the longest unbroken runs of shared positions of each record,
    counted from 1, both ends included. A position is shared if it lies in a span of ``least``
    letters that stands in the text of another id too.

    Records with a null id and null, empty or too short texts have no runs. A record listed
    several times with one text counts once; texts of different ids that are equal share
    everything. Very long texts are taken whole; letters beyond ASCII count as one each; extra
    columns are ignored; an empty table gives no runs. Texts are told apart by 128 bits.
    """
    texts = _texts(df, id_col, text_col, least)
    shared = cut(_several(_anchor_rows(texts, least), hot))
    table = np.zeros(SLOTS, bool)  # hot anchors, by slots of a fixed number; a slot's other anchors go the same way
    table[shared.where("slot IS NOT NULL").select("slot").distinct().toArrow().column(0).to_numpy()] = True
    found = cut(_span_rows(_chunk_rows(texts, shared.where("slot IS NULL").drop("slot"), table, least), least))
    spans = found.where("kind = 1").select("s", "t", "a", "h1", "h2")
    differ = "s_lo <> s_hi OR t_lo <> t_hi"
    several = spans.groupBy("h1", "h2").agg(*[f(c).alias(f"{c}_{n}") for c in ("s", "t") for f, n in ((F.min, "lo"), (F.max, "hi"))]).where(differ).select("h1", "h2")
    hot_runs = spans.join(several, ["h1", "h2"], "left_semi").select("s", "t", "a", (F.col("a") + least - 1).alias("b"))
    # Copies of a text: all of it is shared.
    m = texts.select("id", "s", "t", F.length("text").alias("size")).distinct()
    copied = m.groupBy("s", "t", "size").agg(F.count(F.lit(1)).alias("ids")).where("ids > 1").select("s", "t", F.lit(0).cast("long").alias("a"), (F.col("size") - 1).cast("long").alias("b"))
    runs = found.where("kind = 0").select("s", "t", "a", "b").unionByName(hot_runs).unionByName(copied)
    w = Window.partitionBy("s", "t").orderBy("a", "b")
    before = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    label = F.sum(F.when(F.col("a") <= F.col("before") + 1, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    merged = runs.withColumn("before", before).withColumn("g", label).groupBy("s", "t", "g").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return merged.join(m.select("id", "s", "t"), ["s", "t"]).select("id", (F.col("a") + 1).cast("int").alias("span_start"), (F.col("b") + 1).cast("int").alias("span_end")).distinct()


def shared_share(df: DataFrame, id_col: str, text_col: str, least: int = 40) -> DataFrame:
    """Per record with a non-null id and text: id, letters, shared letters, share (0 for an
    empty text). A record listed with several texts gets their longest."""
    per = shared_runs(df, id_col, text_col, least).groupBy("id").agg(F.sum(F.col("span_end") - F.col("span_start") + 1).alias("shared"))
    size = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.length(F.col(text_col))).alias("letters"))
    shared = F.coalesce("shared", F.lit(0))
    return size.join(per, "id", "left").select("id", "letters", shared.alias("shared"), F.when(F.col("letters") > 0, shared / F.col("letters")).otherwise(F.lit(0.0)).alias("share"))

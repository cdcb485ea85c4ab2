"""Filling fixed-capacity containers with items, neighbours together.

Lexical retrieval packing: items are spread over shards by what they are about, so that a text's
neighbours lie in its own shard; each shard, bounded in items and letters, keeps a BM25 inverted
index of its texts. The largest unused item opens a container and is its seed; the index returns
the seed's unused neighbours, best first, and those that fit fill the container. What room is
left is filled exactly: the unused sizes that come closest to it. Only an item above the
capacity is cut, into full containers and a rest.
"""

from __future__ import annotations

import bisect
import copy
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociq.llm.bpe import with_counts
from lociq.llm.windows import pieces
from lociq.session import cut

_TERM = regex.compile(r"\p{L}[\p{L}\p{N}_]+|[\p{Han}\p{Hiragana}\p{Katakana}]{2}")
K1, B = 1.2, 0.75


class Index:
    """BM25 inverted index of a shard: one array of items and one of weights, by term."""

    def __init__(self, texts: Sequence[str | None]):
        number: dict[str, int] = {}
        term, often, distinct = [], [], []
        for t in texts:
            d = Counter(_TERM.findall(t.lower())) if t else {}
            term += [number.setdefault(x, len(number)) for x in d]
            often += d.values()
            distinct.append(len(d))
        self.n = n = len(distinct)
        term, often = np.array(term, np.int64), np.array(often, float)
        edge = np.concatenate([[0], np.cumsum(distinct, dtype=np.int64)])
        item = np.repeat(np.arange(n), distinct)
        size = np.bincount(item, often, n)
        df = np.bincount(term, minlength=len(number))
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        weight = idf[term] * often * (K1 + 1) / (often + K1 * (1 - B + B * size[item] / max(1.0, size.mean() if n else 1.0)))
        order = np.argsort(term, kind="stable")
        self.term, self.item, self.weight = term[order], item[order], weight[order]
        self.start = np.concatenate([[0], np.cumsum(df)])
        self.key, self.most = self.term, 0
        # A seed asks with all of its terms that another item has.
        self.terms = []
        for i in range(n):
            own = term[edge[i] : edge[i + 1]]
            self.terms.append(np.sort(own[df[own] > 1]))

    def by_size(self, sizes: Sequence[int]) -> Index:
        """The index with each term's items by size, so that those that fit a room come first."""
        out, size = copy.copy(self), np.asarray(sizes, np.int64)
        out.most = int(size.max()) + 1 if len(size) else 1
        key = self.term * out.most + size[self.item]
        order = np.argsort(key, kind="stable")
        out.key, out.term, out.item, out.weight = key[order], self.term[order], self.item[order], self.weight[order]
        return out

    def without(self, used: np.ndarray) -> Index:
        """The index of the unused items: the same scores, in less time."""
        out = copy.copy(self)
        keep = used[self.item] == 0
        out.key, out.term, out.item, out.weight = self.key[keep], self.term[keep], self.item[keep], self.weight[keep]
        out.start = np.concatenate([[0], np.cumsum(keep)])[self.start]
        return out

    def neighbours(self, seed: int, used: np.ndarray, room: int | None = None) -> Iterator[int]:
        """Unused items that share a term with the seed and, of an index by size, fit the room;
        best first, as they are asked for: the best few are sorted first and the others only if
        those didn't do."""
        terms = self.terms[seed]
        if not len(terms):
            return
        first, last = self.start[terms], self.start[terms + 1]
        if room is not None and room < self.most:
            last = np.searchsorted(self.key, terms * self.most + room, "right")
        asked = [slice(x, y) for x, y in zip(first.tolist(), last.tolist(), strict=True) if x < y]
        if not asked:
            return
        score = np.bincount(np.concatenate([self.item[s] for s in asked]), np.concatenate([self.weight[s] for s in asked]), self.n)
        score[used != 0] = 0
        score[seed] = 0
        found = np.nonzero(score)[0]
        most = 64
        while len(found):
            s = score[found]
            # All that score as high as the last of the best come with them.
            top = s >= np.partition(s, len(s) - most)[len(s) - most] if most < len(s) else np.ones(len(s), bool)
            best = found[top]
            yield from best[np.lexsort((best, -s[top]))].tolist()
            found, most = found[~top], most * 8


class _Sizes:
    """Unused items by size, to find the largest that fits a room."""

    def __init__(self, sizes: Sequence[int], ids: Sequence[int]):
        self.at: dict[int, list[int]] = defaultdict(list)
        for i in ids:
            self.at[sizes[i]].append(i)
        self.order = sorted(self.at)

    def largest(self, most: int, used: bytearray) -> int | None:
        k = bisect.bisect_right(self.order, most)
        while k:
            s = self.order[k - 1]
            group = self.at[s]
            while group and used[group[-1]]:
                group.pop()
            if group:
                return group[-1]
            del self.order[k - 1]
            k -= 1
        return None


def fill(sizes: Sequence[int], index: Index, capacity: int) -> list[tuple[int, int, int, int]]:
    """(item, piece, container, tokens) of a shard's items; containers count from 0."""
    out, used, box = [], bytearray(len(sizes)), 0
    marks = np.frombuffer(used, np.uint8)  # the same memory
    rest = list(sizes)
    piece = [0] * len(sizes)
    for i, s in enumerate(sizes):
        while rest[i] > capacity:  # only these are cut
            out.append((i, piece[i], box, capacity))
            rest[i] -= capacity
            piece[i] += 1
            box += 1
    empty = [i for i, s in enumerate(rest) if s == 0]
    for i in empty:
        used[i] = 1
    by_size = _Sizes(rest, [i for i, s in enumerate(rest) if s])
    index = index.by_size(rest)
    home, left = None, len(sizes) - len(empty)
    while (seed := by_size.largest(capacity, used)) is not None:
        used[seed] = 1
        out.append((seed, piece[seed], box, rest[seed]))
        room = capacity - rest[seed]
        least = capacity // 16
        if room >= least:
            if 2 * (now := len(sizes) - int(marks.sum())) < left:
                index, left = index.without(marks), now
            for i in index.neighbours(seed, marks, room):
                if rest[i] <= room:
                    used[i] = 1
                    out.append((i, piece[i], box, rest[i]))
                    room -= rest[i]
                    if room < least:
                        break
        while room and (i := by_size.largest(room, used)) is not None:
            used[i] = 1
            out.append((i, piece[i], box, rest[i]))
            room -= rest[i]
        home = box if home is None else home
        box += 1
    # Items of no tokens need no room; they go to the shard's first container.
    out += [(i, 0, home or 0, 0) for i in empty]
    return out


class Topics:
    """What a text is about: its nearest of some centroids, over hashed terms. Fitted on a
    bounded sample by spherical k-means; only the order of texts depends on it, every text is
    placed and indexed."""

    def __init__(self, sample: np.ndarray, topics: int, rounds: int = 10):
        seen = (sample > 0).sum(0)
        self.idf = np.log((len(sample) + 1) / (seen + 1)).astype(np.float32) + np.float32(0.01)
        x = self._unit(sample)
        x = x[x.any(axis=1)]
        g, c = np.random.default_rng(0), x[:1]
        near = x @ c[0] if len(x) else x
        while 0 < len(c) < topics:
            far = np.clip(1 - near, 0, None) ** 2
            if far.sum() < 1e-6:
                break
            c = np.concatenate([c, x[[g.choice(len(x), p=far / far.sum())]]])
            near = np.maximum(near, x @ c[-1])
        for _ in range(rounds if len(c) else 0):
            own = (x @ c.T).argmax(1)
            for k in range(len(c)):
                if (own == k).any():
                    c[k] = x[own == k].sum(0)
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        # Centroids are numbered so that each is followed by the one most like it.
        order, left = [0] if len(c) else [], list(range(1, len(c)))
        while left:
            order.append(left.pop(int((c[left] @ c[order[-1]]).argmax())))
        self.centroids = c[order]

    def _unit(self, x: np.ndarray) -> np.ndarray:
        x = x * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), np.float32(1e-9))

    def nearest(self, texts: Sequence[str | None], width: int) -> np.ndarray:
        """(texts, 3) numbers of the three nearest centroids, the nearest first; -1 where a text
        has no terms."""
        out = np.full((len(texts), 3), -1, np.int32)
        for at in range(0, len(texts) if len(self.centroids) else 0, 1000):
            x = hashed_terms(texts[at : at + 1000], width)
            near = np.argsort(-(self._unit(x) @ self.centroids.T), axis=1, kind="stable")[:, :3]
            some = x.any(axis=1)
            out[at : at + 1000, : near.shape[1]][some] = near[some]
        return out


def hashed_terms(texts: Sequence[str | None], width: int) -> np.ndarray:
    """(texts, width) log counts of each text's terms, by a hash of the term."""
    out = np.zeros((len(texts), width), np.float32)
    for i, t in enumerate(texts):
        if t:
            n = Counter(_TERM.findall(t.lower()))
            np.add.at(out[i], np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % width for w in n), np.int64, len(n)), np.log1p(np.fromiter(n.values(), np.float32, len(n))))
    return out


def fit_topics(items: DataFrame, id_col: str, text_col: str, count: int, sample: int = 4096, topics: int = 64, width: int = 1024) -> Topics:
    """Topics of about ``sample`` items, chosen by a hash of id and text: a bounded sample, of
    which the driver sees ``width`` numbers each."""
    h = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    share = min(1.0, sample / max(1, count))
    some = items.where(F.col(text_col).isNotNull() & (h.cast("decimal(20,0)") < F.lit(str(int(-(1 << 63) + share * ((1 << 64) - 1)))).cast("decimal(20,0)")))

    def run(batches):
        for b in batches:
            x = hashed_terms(b.column(0).to_pylist(), width)
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in x], pa.binary())], names=["v"])

    rows = some.select(F.col(text_col)).mapInArrow(run, "v binary").toArrow().column(0).to_pylist()
    return Topics(np.frombuffer(b"".join(sorted(rows)), np.float32).reshape(-1, width).copy(), topics)


def pack(items: DataFrame, specs: DataFrame, id_col: str, text_col: str, size_col: str, shard_items: int = 12_288, shard_letters: int = 16_000_000, topics: int = 64, sample: int = 4096, source: DataFrame | None = None) -> DataFrame:
    """(spec_id, id, piece, container, tokens): a container for every item and capacity.

    ``items`` has an id, a text and a size; ``specs`` spec_id and capacity (a handful of rows;
    more than 1,000 raise an error, and so does a capacity below 1). An item of no tokens
    (null and empty texts) gets a container too. An item above the capacity is cut into pieces
    of the capacity and a rest; no other item is cut. Equal items go in any order, the same in
    every run. Repeated rows are items of their own. Container names hold their shard. An empty
    table gives no rows; null ids are items like others.

    Items are range-sorted by their three nearest topics and then by hashes, so that likes are
    neighbours and neither a topic nor a group of copies makes a large shard. A shard ends at
    ``shard_items`` items or ``shard_letters`` letters (a longer text alone), so none grows with
    the table; neighbours are looked for within the shard. Topics are fitted on about ``sample``
    items. ``source`` holds the items' ids and texts where those come more cheaply than sizes.
    """
    wanted = [(r[0], int(r[1])) for r in specs.select("spec_id", "capacity").where("capacity IS NOT NULL").limit(1001).collect()]
    if len(wanted) > 1000 or any(c < 1 for _, c in wanted):
        raise ValueError("specs must be at most 1,000 rows of capacities of at least 1")
    from pyspark.sql.pandas.types import to_arrow_type

    spec_type, width = specs.schema["spec_id"].dataType, 1024
    arrow_spec = to_arrow_type(spec_type)
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(size_col).cast("int").alias("size"))
    plain = rows if source is None else source.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    count, letters = plain.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    known = rows.sparkSession.sparkContext.broadcast(fit_topics(plain, "id", "text", count, sample, topics, width))  # topics x width numbers

    def about(batches):
        for b in batches:
            near = known.value.nearest(b.column(1).to_pylist(), width)
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(near[:, i]) for i in range(3)]], names=[*b.schema.names, "t0", "t1", "t2"])

    placed = rows.mapInArrow(about, T.StructType([*rows.schema.fields, *[T.StructField(f"t{i}", T.IntegerType()) for i in range(3)]]))
    # Sorting looks at its input twice; what was counted and placed is kept for it.
    placed = cut(placed.withColumn("h", F.xxhash64(F.col("id").cast("string"), "text")).withColumn("row", F.monotonically_increasing_id()))
    shards = max(1, -(-count // shard_items), -(-letters // shard_letters))
    order = ["t0", "t1", "t2", "h", "row"]
    ranged = placed.repartitionByRange(shards, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "id", "text", "size")

    def shard(t: pa.Table, name: str) -> pa.RecordBatch:
        order = sorted(range(t.num_rows), key=lambda i, a=t.column(1).to_pylist(), b=t.column(2).to_pylist(): (a[i] is None, a[i], b[i] or ""))
        t = t.take(pa.array(order))
        sizes, index = [s or 0 for s in t.column(3).to_pylist()], Index(t.column(2).to_pylist())
        rows: list[tuple] = []
        for spec, capacity in wanted:
            rows += [(spec, i, p, f"{name}-{c}", n) for i, p, c, n in fill(sizes, index, capacity)]
        spec, i, p, c, n = zip(*rows, strict=True) if rows else ((), (), (), (), ())
        ids = t.column(1).combine_chunks().take(pa.array(i, pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(spec, arrow_spec), ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids, pa.array(p, pa.int32()), pa.array(c, pa.string()), pa.array(n, pa.int32())], names=["spec_id", "id", "piece", "container", "tokens"])

    def run(batches):
        held, n, size, done = [], 0, 0, 0
        for whole in batches:
            for b in pieces(iter([whole]), 2, shard_letters // 4):
                long = pa.compute.sum(pa.compute.utf8_length(b.column(2))).as_py() or 0
                # A range holds about a shard; only one far beyond it is cut.
                if held and (n + b.num_rows > 1.5 * shard_items or size + long > 1.5 * shard_letters):
                    yield shard(pa.Table.from_batches(held), f"{held[0].column(0)[0]}.{done}")
                    held, n, size, done = [], 0, 0, done + 1
                held.append(b)
                n, size = n + b.num_rows, size + long
        if held:
            yield shard(pa.Table.from_batches(held), f"{held[0].column(0)[0]}.{done}")

    schema = T.StructType([
        T.StructField("spec_id", spec_type), T.StructField("id", items.schema[id_col].dataType), T.StructField("piece", T.IntegerType()),
        T.StructField("container", T.StringType()), T.StructField("tokens", T.IntegerType()),
    ])
    return ranged.mapInArrow(run, schema)


def pack_texts(docs: DataFrame, specs: DataFrame, id_col: str, text_col: str, name: str = "byte_bpe_50k", **settings: int) -> DataFrame:
    """``pack`` with sizes in tokens of a public tokenizer, counted by the token automaton."""
    return pack(with_counts(docs.select(id_col, text_col), text_col, "tokens", name), specs, id_col, text_col, "tokens", source=docs, **settings)


def violations(packed: DataFrame, sizes: DataFrame, specs: DataFrame, id_col: str, size_col: str) -> DataFrame:
    """What a packing must not do, per capacity, for items of unique ids: items (all of them must
    be there), containers beyond the capacity, items in more pieces than they need, tokens that
    differ from the item's size."""
    s = specs.select("spec_id", "capacity")
    over = packed.groupBy("spec_id", "container").agg(F.sum("tokens").alias("n")).join(F.broadcast(s), "spec_id").groupBy("spec_id").agg(F.count(F.when(F.col("n") > F.col("capacity"), 1)).alias("over_capacity"))
    per = packed.groupBy("spec_id", "id").agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("pieces")).join(sizes.select(F.col(id_col).alias("id"), F.col(size_col).alias("size")), "id", "left").join(F.broadcast(s), "spec_id")
    need = F.greatest(F.lit(1), F.ceil(F.col("size") / F.col("capacity")))
    items = per.groupBy("spec_id", "capacity").agg(F.count(F.lit(1)).alias("items"), F.count(F.when(F.col("pieces") > need, 1)).alias("cut_needlessly"), F.sum(F.abs(F.col("n") - F.coalesce("size", F.lit(0)))).alias("tokens_astray"))
    return items.join(over, "spec_id").select("spec_id", "capacity", "items", "over_capacity", "cut_needlessly", "tokens_astray")


def usage(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """Per capacity: containers, tokens, unused room and its share."""
    per = packed.groupBy("spec_id", "container").agg(F.sum("tokens").alias("tokens"))
    total = per.groupBy("spec_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"))
    room = F.col("containers") * F.col("capacity")
    return total.join(F.broadcast(specs.select("spec_id", "capacity")), "spec_id").select("spec_id", "capacity", "containers", "tokens", (room - F.col("tokens")).alias("unused"), F.round((room - F.col("tokens")) / room, 6).alias("unused_share"))

"""Text that was decoded with the wrong character encoding: find it and restore it.

Noisy channel. A word that holds characters beyond ASCII may be what somebody wrote, or what a
wrong codec made of other bytes. For every channel (written as, read as) the word is turned
back into a byte lattice, in which a lost byte (``?`` or U+FFFD) is a wildcard, and a Viterbi
search finds the likeliest ways through it under the corpus's word frequencies, which fall back
on its letter pairs for words that it doesn't know. What it proposes is held against exact word
counts: the restored word has to be the likelier one. For a swap of codecs the words of a
document speak together, channel by channel; what that explains is taken out of the counts, and
the words are weighed again.

Corpus statistics are taken over all documents. Word counts stay a distributed table. Only
counters of a fixed number are broadcast: letter pairs, and a sketch of the word frequencies.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from heapq import nlargest

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociq.session import cut

#: Codecs that UTF-8 is taken for. Fixed values.
READ_AS = ("cp1252", "latin-1", "cp1250", "iso8859-2", "iso8859-15", "mac_roman", "cp437", "cp850", "cp852", "cp1251", "koi8-r", "cp866", "mac_cyrillic", "iso8859-5", "cp1253", "cp1254")
#: Pairs (written as, read as) of other codecs. Fixed values.
SWAPPED = (
    ("iso8859-2", "latin-1"), ("iso8859-2", "cp1252"), ("cp1250", "cp1252"), ("cp1250", "latin-1"), ("cp1252", "cp1250"), ("cp1252", "iso8859-2"),
    ("cp1251", "cp1252"), ("cp1251", "latin-1"), ("koi8-r", "cp1252"), ("koi8-r", "latin-1"), ("cp866", "cp1252"), ("cp866", "cp1251"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp1251", "cp866"),
    ("cp1252", "cp1251"), ("cp1252", "koi8-r"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "latin-1"), ("cp437", "latin-1"),
    ("shift_jis", "cp1252"), ("shift_jis", "latin-1"), ("euc_jp", "cp1252"), ("euc_jp", "latin-1"), ("iso8859-5", "cp1252"), ("iso8859-5", "latin-1"),
)
LOST = "�"
PAIRS, SINGLES, WORDS = 1 << 20, 0x110000, 1 << 19  # single characters have a counter each
_WORD = regex.compile(r"[A-Za-z]*(?:[^\x00-\x7f]+\?*[A-Za-z]*)+")
_EDGE = "\x02"


def words(text: str) -> list[str]:
    """Maximal runs of letters and characters beyond ASCII (with the ``?`` after them) that
    hold at least one of the latter."""
    return _WORD.findall(text)


def _slot(a: str, b: str) -> int:
    return (ord(a) * 0x9E3779B1 ^ ord(b) * 0x85EBCA6B) % 0xFFFFFFFB & (PAIRS - 1)


def _slots(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = text[:-1].astype(np.uint64), text[1:].astype(np.uint64)
    return ((a * np.uint64(0x9E3779B1) ^ b * np.uint64(0x85EBCA6B)) % np.uint64(0xFFFFFFFB) & np.uint64(PAIRS - 1)).astype(np.int64), a.astype(np.int64)


def _word_slots(word: str) -> tuple[int, int]:
    h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
    return h & (WORDS - 1), (h * 0x9E3779B1 & 0xFFFFFFFF) >> 13


class Letters:
    """Log probabilities of letter pairs and of words, from hashed counters. A word's count is
    the lesser of its two counters, less what an even spread puts in each."""

    def __init__(self, pairs: np.ndarray, singles: np.ndarray, words: np.ndarray | None = None):
        self.pairs, self.singles = pairs, singles
        self.words = np.zeros(2 * WORDS, np.int64) if words is None else words
        self.n_words = float(self.words[:WORDS].sum())
        self.total = float(singles.sum()) + 1
        self.cost = lru_cache(200_000)(self._cost)

    def _cost(self, a: str, b: str) -> float:
        left, right = float(self.singles[ord(a)]), float(self.singles[ord(b)])
        alone = (right + 1e-3) / (self.total + 65.536)
        # A pair can't be commoner than its letters: what other pairs left in its slot is cut off.
        seen = min(float(self.pairs[_slot(a, b)]), left, right)
        return math.log((seen + 0.5 * alone) / (left + 0.5))

    def known(self, c: str) -> bool:
        return self.singles[ord(c)] > 0

    def score(self, word: str) -> float:
        """By letter pairs alone."""
        at, s = _EDGE, 0.0
        for c in word:
            s += self.cost(at, c)
            at = c
        return s + self.cost(at, _EDGE)

    def likely(self, word: str, unknown: float = 0.05) -> float:
        """By the word's frequency; a share ``unknown`` of all words is left to letter pairs."""
        i, j = _word_slots(word)
        n = max(0.0, min(float(self.words[i]), float(self.words[WORDS + j])) - self.n_words / WORDS)
        return math.log((1 - unknown) * n / (self.n_words + 1) + unknown * math.exp(max(self.score(word), -600.0)))


@lru_cache(64)
def _bytes_of(codec: str) -> dict[str, int]:
    """Upper byte of each character of a single-byte codec; bytes it leaves out are read as
    control characters."""
    out: dict[str, int] = {}
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(c, b)
    return out


def _sequence(lattice: list[int | None], i: int) -> int:
    """Length of the UTF-8 sequence that may start at byte ``i`` of the lattice; 0 if none may."""
    b = lattice[i]
    if b is None or not 0xC2 <= b <= 0xF4:
        return 0
    n = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
    rest = lattice[i + 1 : i + n]
    return n if len(rest) == n - 1 and all(x is None or 0x80 <= x <= 0xBF for x in rest) else 0


def _readings(part: tuple[int | None, ...], letters: Letters) -> tuple[str, ...]:
    """Characters that the corpus knows and a UTF-8 sequence with wildcards may stand for: all of
    them, however many bytes were lost."""
    n = len(part)
    at = np.array([part[0] & (0x1F, 0x0F, 0x07)[n - 2]], np.int64)
    for x in part[1:]:
        at = (at[:, None] << 6 | (np.arange(64) if x is None else np.array([x & 0x3F]))[None]).ravel()
    least = (0x80, 0x800, 0x10000)[n - 2]
    at = at[(at >= least) & (at <= 0x10FFFF) & ((at < 0xD800) | (at > 0xDFFF))]
    return tuple(map(chr, at[letters.singles[at] > 0].tolist()))


@lru_cache(64)
def _shape(codec: str) -> regex.Pattern:
    """What a UTF-8 sequence looks like when read by a codec, lost bytes included."""
    of: dict[int, str] = {b: regex.escape(c) for c, b in _bytes_of(codec).items()}
    some = lambda lo, hi: "".join(of[b] for b in range(lo, hi + 1) if b in of)
    tail = f"[{some(0x80, 0xBF)}?{LOST}]"
    kinds = ((0xC2, 0xDF, 1), (0xE0, 0xEF, 2), (0xF0, 0xF4, 3))
    return regex.compile("|".join(f"[{some(lo, hi)}]{tail}{{{n}}}" for lo, hi, n in kinds if some(lo, hi)))


def undo_utf8(word: str, codec: str, letters: Letters, paths: int = 4) -> str | None:
    """The likeliest word whose UTF-8 bytes, read by ``codec``, give ``word``; None if no part
    of it can be read so. Characters that fit no sequence stay. A sequence must stand for a
    character that the corpus knows.

    The search keeps the ``paths`` best ways by letter pairs to each possible last character, and
    word frequencies decide among what comes through; with 1 it is a plain Viterbi search.
    """
    if not _shape(codec).search(word):
        return None
    table = _bytes_of(codec)
    lattice: list[int | None] = [None if c in "?" + LOST else table.get(c, -1) for c in word]
    steps: list[tuple[str, ...]] = []  # what each place of the restored word may be
    i, some = 0, False
    while i < len(word):
        size = _sequence(lattice, i) if lattice[i] is not None and lattice[i] > 0 else 0
        options = _readings(tuple(lattice[i : i + size]), letters) if size else ()
        some |= bool(options)
        steps.append(options or (word[i],))
        i += size if options else 1
    if not some:
        return None
    if all(len(x) == 1 for x in steps):  # one way through the lattice
        return "".join(x[0] for x in steps)
    # Viterbi: the states at a place are the possible last characters, with the best ways there.
    states: dict[str, list[tuple[float, str]]] = {_EDGE: [(0.0, "")]}
    for options in steps:
        states = {c: nlargest(paths, ((s + letters.cost(p, c), t + c) for p, ways in states.items() for s, t in ways)) for c in options}
    return max((t for ways in states.values() for _, t in ways), key=lambda t: (letters.likely(t), t))


def undo_swap(word: str, written: str, read: str) -> str | None:
    """The word with its bytes read as they were written; None where that isn't possible."""
    try:
        return word.encode(read).decode(written)
    except UnicodeDecodeError:
        return None
    except UnicodeEncodeError:
        pass
    table = _bytes_of(read)
    raw = bytearray()
    for c in word:
        b = ord(c) if ord(c) < 128 else table.get(c)
        if b is None:
            return None
        raw.append(b)
    try:
        return raw.decode(written)
    except UnicodeDecodeError:
        return None


def proposals(word: str, letters: Letters, depth: int | None = None, width: int | None = None) -> list[tuple[str, str, int, float]]:
    """(restored, kind, channel, gain) for a word: ``utf8`` where its bytes are valid UTF-8 under
    some codec; else, for every pair of codecs that makes another word of known letters, ``swap``,
    or ``sure`` where that is likelier beyond doubt (e^20 times). Damage done twice is undone twice.

    Undoing goes on until nothing new comes up, on every word of a round; ``depth`` and ``width``
    bound the rounds and the words taken on from each, where time matters more.
    """
    own = letters.score(word)
    out: dict[str, float] = {}
    level, done, rounds = [word], {word}, 0
    while level and rounds != depth:
        # A word that was garbled twice may look no better halfway, so the way on is open to
        # all of a round, and the outcome is held against the word as it stands.
        further: dict[str, float] = {}
        for w in level:
            for codec in READ_AS:
                c = undo_utf8(w, codec, letters)
                if c and c not in done:
                    done.add(c)
                    further[c] = s = letters.score(c)
                    if s > own:
                        out[c] = s - own
        level = sorted(further, key=lambda c: (-further[c], c))[:width]
        rounds += 1
    if out:
        return [(c, "utf8", -1, gain) for c, gain in sorted(out.items(), key=lambda x: (-x[1], x[0]))]
    swaps = []
    for k, (written, read) in enumerate(SWAPPED):
        c = undo_swap(word, written, read)
        if c and c != word and all(letters.known(x) for x in c if x > "\x7f"):
            gain = letters.score(c) - own
            swaps.append((c, "sure" if gain > 20 and len(word) >= 4 else "swap", k, gain))
    return swaps


# --- Spark stages ---------------------------------------------------------------------


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, n) over all documents, for words with a character beyond ASCII."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            c: Counter[str] = Counter()
            for t in b.column(0).to_pylist():
                if t and not t.isascii():
                    c.update(words(t))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])

    return docs.select(F.col(text_col)).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letter_pairs(counts: DataFrame) -> Letters:
    """The model of a word table: letter pairs and the sketch of its frequencies. What reaches
    the driver is at most one number a counter, however large the corpus."""

    def run(batches):
        pairs, singles, words = np.zeros(PAIRS, np.int64), np.zeros(SINGLES, np.int64), np.zeros(2 * WORDS, np.int64)
        for b in batches:
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                p, s = _slots(np.frombuffer((_EDGE + w + _EDGE).encode("utf-32-le", "surrogatepass"), np.uint32))
                np.add.at(pairs, p, n)
                np.add.at(singles, s, n)
                i, j = _word_slots(w)
                words[i] += n
                words[WORDS + j] += n
        whole = np.concatenate([pairs, singles, words])
        at = np.nonzero(whole)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(whole[at])], names=["slot", "n"])

    rows = counts.mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    whole = np.zeros(PAIRS + SINGLES + 2 * WORDS, np.int64)
    whole[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return Letters(whole[:PAIRS], whole[PAIRS : PAIRS + SINGLES], whole[PAIRS + SINGLES :])


_MODELS: dict[int, Letters] = {}


class _Model:
    """A broadcast model, put together once in each worker."""

    def __init__(self, sc, letters: Letters):
        self.data = sc.broadcast((letters.pairs, letters.singles, letters.words))
        self.id = int(letters.pairs.sum()) ^ int(np.bitwise_xor.reduce(letters.pairs * np.arange(1, PAIRS + 1)))

    def get(self) -> Letters:
        if self.id not in _MODELS:
            _MODELS.clear()
            _MODELS[self.id] = Letters(*self.data.value)
        return _MODELS[self.id]


def _proposed(counts: DataFrame, model: _Model) -> DataFrame:
    """(word, restored, kind, channel, gain, n_raw): what each different word of the corpus may
    have been; each is searched once, wherever and however often it stands."""

    def run(batches):
        letters = model.get()
        for b in batches:
            rows = []
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows += [(w, *x, n) for x in proposals(w, letters)]
            w, c, k, at, gain, n = zip(*rows, strict=True) if rows else ((), (), (), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(c, pa.string()), pa.array(k, pa.string()), pa.array(at, pa.int32()), pa.array(gain, pa.float64()), pa.array(n, pa.int64())], names=["word", "restored", "kind", "channel", "gain", "n_raw"])

    # A fixed number of tasks: the search costs far more time than its bytes tell the planner.
    spark = counts.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = counts.repartition(tasks, "word")
    return spread.select("word", "n").mapInArrow(run, "word string, restored string, kind string, channel int, gain double, n_raw long")


def _channels(rows: DataFrame, swaps: DataFrame, least: float = 3.0, cap: float = 4.0) -> DataFrame:
    """(doc, channel): the swap of codecs that a document's words speak for together. Each word
    gives the log of how much commoner its restored form is, against it where it is rarer; two
    words at least have to speak for the channel, and not single characters alone."""
    e = F.greatest(F.lit(-cap), F.least(F.lit(cap), F.log((F.greatest("n_new", F.lit(0)) + 0.5) / (F.greatest("n_raw", F.lit(0)) + 0.5))))
    per = rows.join(swaps.select("word", "channel", e.alias("e")), "word").groupBy("doc", "channel").agg(F.sum("e").alias("e"), F.sum((F.col("e") > 0).cast("int")).alias("k"), F.max((F.col("e") > 0) & (F.length("word") > 1)).alias("long"))
    return per.where((F.col("e") >= least) & (F.col("k") >= 2) & F.col("long")).groupBy("doc").agg(F.max_by("channel", F.struct("e", -F.col("channel"))).alias("channel"))


def damaged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, word, restored): words of documents that came from a wrong decoding, and the
    likeliest original; null where a lost character can't be told."""
    counts = cut(word_counts(docs, text_col))
    model = _Model(docs.sparkSession.sparkContext, letter_pairs(counts))
    asked = cut(_proposed(counts, model).join(counts.select(F.col("word").alias("restored"), F.col("n").alias("n_new")), "restored", "left").where("n_new >= 3 OR kind <> 'swap'"))
    w = document_words(docs, id_col, text_col)
    swaps = asked.where("channel >= 0 AND n_new >= 3")
    # Only words that some channel turns into a word of the corpus can speak.
    rows = cut(w.join(swaps.select("word").distinct(), "word", "left_semi").groupBy("id", "doc", "word").agg(F.sum("n").alias("n")))
    # What the first pass explains goes from the garbled words' counts to the restored ones'.
    first = rows.join(_channels(rows, swaps), "doc").join(swaps.select("word", "channel", "restored"), ["word", "channel"])
    moved = cut(first.groupBy("word", "restored").agg(F.sum("n").alias("m")))
    gone, come = moved.groupBy("word").agg(F.sum("m").alias("gone")), moved.groupBy("restored").agg(F.sum("m").alias("come"))
    again = swaps.join(gone, "word", "left").join(come, "restored", "left").join(gone.select(F.col("word").alias("restored"), F.col("gone").alias("lost")), "restored", "left")
    again = again.join(come.select(F.col("restored").alias("word"), F.col("come").alias("won")), "word", "left").join(moved, ["word", "restored"], "left").na.fill(0, ["gone", "come", "lost", "won", "m"])
    again = cut(again.withColumn("seen", F.col("n_raw")).withColumn("n_raw", F.col("n_raw") - F.col("gone") + F.col("won")).withColumn("n_new", F.col("n_new") + F.col("come") - F.col("lost")))
    told = rows.join(_channels(rows, again), "doc").join(again.select("word", "channel", "restored"), ["word", "channel"]).select("id", "word", "restored")
    # Bytes that are valid UTF-8 and make likelier letters prove enough, and word counts pick
    # among such readings. A swap of codecs that only one word of a document speaks for needs
    # likelier letters, or documents that explain most of the word, and a far commoner restored
    # word; a single character has no letters around it that could tell.
    plain = asked.where("kind <> 'swap'").select("word", "restored", F.coalesce("n_new", F.lit(0)).alias("n_new"))
    known = (F.length("word") > 1) & (F.col("n_new") >= 3) & (F.col("n_new") >= 3 * F.col("n_raw")) & ((F.col("gain") > 4) | (2 * F.col("m") >= F.col("seen")))
    best = plain.unionByName(again.where(known).select("word", "restored", "n_new")).groupBy("word").agg(F.max_by("restored", F.struct("n_new", -F.length("restored"), F.col("restored"))).alias("restored"))
    # A lost character: the commonest word of the corpus that fits around it.
    whole = counts.where(~F.col("word").contains(LOST)).select(F.col("word").alias("fit"), "n", F.regexp_replace("word", r"[^\x00-\x7f]", LOST).alias("hull"))
    lost = counts.where(F.col("word").contains(LOST)).select("word", F.regexp_replace("word", r"[^\x00-\x7f]", LOST).alias("hull"))
    # The better half of the join is summed up first, so that a common hull is one row.
    whole = whole.groupBy("hull").agg(F.max_by("fit", F.struct("n", "fit")).alias("fit"))
    found = lost.join(whole, "hull", "left").select("word", F.col("fit").alias("restored"))
    bad = cut(best.join(lost.select("word"), "word", "left_anti").unionByName(found))
    # A document's own channel goes before what holds for the word everywhere.
    both = w.join(bad, "word").select("id", "word", "restored", F.lit(0).alias("own")).unionByName(told.withColumn("own", F.lit(1)))
    return both.groupBy("id", "word").agg(F.max_by("restored", F.struct("own", "restored")).alias("restored"))


def document_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, doc, word, n): the different words beyond ASCII of each document and how often they
    stand there; ``doc`` tells documents of one id, or of none, apart."""

    def run(batches):
        for b in batches:
            at, doc, out, often = [], [], [], []
            for i, (x, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if t and not t.isascii():
                    w = Counter(words(t))
                    if LOST in t:
                        w[LOST] += 0  # also where it stands in no word
                    out += w
                    often += w.values()
                    at += [i] * len(w)
                    doc += [int.from_bytes(blake2b(f"{x!r} {t}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)] * len(w)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(doc, pa.int64()), pa.array(out, pa.string()), pa.array(often, pa.int64())], names=["id", "doc", "word", "n"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("doc", T.LongType()), T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def garbled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id): documents with at least one character that came from a wrong decoding, U+FFFD
    included, whether or not the original can be recovered.

    Null and empty texts are clean. Repeated ids come out once; a null id is kept. Whole texts
    are searched, however long; other columns are ignored; an empty table gives no rows.
    """
    lost = docs.where(F.col(text_col).contains(LOST)).select(F.col(id_col).alias("id"))
    return damaged(docs, id_col, text_col).select("id").unionByName(lost).distinct()


def restored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, restored_words, open_words): garbled documents with their text restored as
    far as possible; open_words counts damaged words that keep a lost character.

    Cases as ``garbled``; ids must be unique here, since a text is restored by its id.
    """
    hit = cut(damaged(docs, id_col, text_col))
    fixes = hit.where("restored IS NOT NULL").groupBy("id").agg(F.map_from_entries(F.collect_set(F.struct("word", "restored"))).alias("fixes"))
    ids = hit.select("id").unionByName(docs.where(F.col(text_col).contains(LOST)).select(F.col(id_col).alias("id"))).distinct().join(fixes, "id", "left")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(ids, "id")

    def run(batches):
        for b in batches:
            out, done, still = [], [], []
            for t, f in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                f, n = dict(f or ()), 0

                def put(m, f=f):
                    nonlocal n
                    r = f.get(m.group())
                    n += r is not None
                    return m.group() if r is None else r

                x = _WORD.sub(put, t)
                out.append(x)
                done.append(n)
                still.append(sum(LOST in w for w in words(x)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array(done, pa.int32()), pa.array(still, pa.int32())], names=["id", "text", "restored_words", "open_words"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("text", T.StringType()), T.StructField("restored_words", T.IntegerType()), T.StructField("open_words", T.IntegerType())])
    return texts.select("id", "text", "fixes").mapInArrow(run, schema)

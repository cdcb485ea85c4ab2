"""Byte-level BPE as a deterministic token automaton.

The merges are compiled in order of rank. The merge (u, v) -> w puts a gadget between u and v:
from then on the arc v may not follow u, because w takes its place. Tokens built later carry
the gadgets of their edges: a token's right edge is the chain of its last parts with the rank
at which each was absorbed, its left edge the chain of its first parts. So state = last token,
arc = next token, and the arc is there unless a gadget of lower rank lies between an open right
edge and an open left edge. An accepted path is the tokenization, and there is exactly one for
any bytes, so every prefix of a word has one state and words are read left to right in one
pass over the table of arcs. Arcs met once are kept in the table.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the public vocabularies lie; a parameter of every function here.
TOKENIZERS = os.environ.get("LOCIQ_TOKENIZERS", "/opt/tokenizers")

#: Pre-splitting pattern of the vocabulary. Fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_NEVER = 1 << 60


def read_merges(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> tuple[dict[int, int], list[tuple[int, int, int]]]:
    """(id of each byte, merges (left id, right id, merged id) by rank) of a ranked vocabulary:
    the last merge inside a token is what its own encoding by all lower ranks ends with."""
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    single = {t[0]: r for t, r in ranks.items() if len(t) == 1}
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], _NEVER))
            if ranks.get(parts[best] + parts[best + 1], _NEVER) >= rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) == 2:
            merges.append((ranks[parts[0]], ranks[parts[1]], rank))
    return single, merges


class Automaton:
    """The compiled automaton. ``encode`` maps a word's bytes to ids, ``decode`` back."""

    def __init__(self, single: dict[int, int], merges: Sequence[tuple[int, int, int]]):
        import ahocorasick

        self.text: dict[int, bytes] = {i: bytes([b]) for b, i in single.items()}
        gadget: dict[tuple[int, int], int] = {}
        right: dict[int, tuple[tuple[int, int], ...]] = {}
        left: dict[int, tuple[tuple[int, int], ...]] = {}
        for i in self.text:
            right[i] = left[i] = ((i, _NEVER),)
        self.gadget, self.right, self.left, self.arcs = gadget, right, left, {}
        for rank, (u, v, w) in enumerate(merges):
            if u not in right or v not in right or (u, v) in gadget:
                continue
            # The new token can only be read where both parts stand side by side unmerged.
            whole = self._open(u, v)
            gadget[u, v] = rank
            if not whole:
                continue
            self.text[w] = self.text[u] + self.text[v]
            # The edges of w: itself, then the edges of its outer parts, absorbed by this rank.
            right[w] = ((w, _NEVER), *((x, min(r, rank)) for x, r in right[v]))
            left[w] = ((w, _NEVER), *((x, min(r, rank)) for x, r in left[u]))
        self.arcs = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.trie = ahocorasick.Automaton()
        for i, t in self.text.items():
            self.trie.add_word(t.decode("latin-1"), (len(t), i))
        self.trie.make_automaton()
        self.split = regex.compile(PATTERN)

    def _open(self, u: int, v: int) -> bool:
        """Whether the arc v leaves state u: no gadget between their edges fires while both
        edge parts stand open, that is, before either was absorbed."""
        gadget = self.gadget
        for x, rx in self.right[u]:
            for y, ry in self.left[v]:
                g = gadget.get((x, y))
                # The leftmost pair goes first: a left part absorbed at this same rank is gone,
                # a right part absorbed at this same rank isn't yet.
                if g is not None and g < rx and g <= ry:
                    return False
        return True

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """Ids of one pre-split word."""
        n = len(word)
        state, size = [-1] * (n + 1), [0] * (n + 1)
        arcs, is_open = self.arcs, self._open
        for end, (length, token) in self.trie.iter(word.decode("latin-1")):
            end += 1
            if state[end] >= 0:
                continue
            begin = end - length
            if begin:
                before = state[begin]
                if before < 0:
                    continue
                key = before << 20 | token
                ok = arcs.get(key)
                if ok is None:
                    ok = arcs[key] = is_open(before, token)
                if not ok:
                    continue
            state[end], size[end] = token, length
        out, at = [], n
        while at:
            out.append(state[at])
            at -= size[at]
        out.reverse()
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, without special tokens."""
        out: list[int] = []
        words = self.words
        for w in self.split.findall(text):
            ids = words.get(w)
            if ids is None:
                if len(words) > 400_000:  # the table of a worker stays bounded
                    words.clear()
                if len(self.arcs) > 2_000_000:
                    self.arcs.clear()
                ids = self.encode_word(w.encode("utf-8", "surrogatepass"))
                if len(w) <= 40:
                    words[w] = ids
            out += ids
        return out

    def decode(self, ids: Sequence[int]) -> str:
        return b"".join(self.text[i] for i in ids).decode("utf-8", "replace")


_COMPILED: dict[str, Automaton] = {}


def automaton(packed: bytes) -> Automaton:
    """The automaton of packed merges, compiled once in each Python worker."""
    key = hashlib.md5(packed).hexdigest()
    if key not in _COMPILED:
        single, merges = json.loads(packed)
        _COMPILED[key] = Automaton({int(k): v for k, v in single.items()}, [tuple(m) for m in merges])
    return _COMPILED[key]


_PACKED: dict[tuple[str, str], bytes] = {}


def pack(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> bytes:
    """The vocabulary's merges as bytes: about 1 MB, of fixed size, sent with the tasks."""
    if (name, folder) not in _PACKED:
        single, merges = read_merges(name, folder)
        _PACKED[name, folder] = json.dumps([single, merges]).encode()
    return _PACKED[name, folder]


def token_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id, ids): token ids of every document, the whole text, without special tokens.

    A null and an empty text both give an empty list. Texts are independent of each other, so
    nothing is shuffled; repeated rows give repeated rows; other columns are ignored. A null
    id is kept.
    """
    sent = docs.sparkSession.sparkContext.broadcast(pack(name, folder))
    names = [id_col, "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(sent.value)
        for b in batches:
            flat, off, begin = [], [0], 0
            for at, t in enumerate(b.column(1).to_pylist()):
                if t:
                    flat += a.encode(t)
                off.append(len(flat))
                if len(flat) > 4_000_000:  # long texts: hand over in between
                    yield _rows(b.column(0).slice(begin, at + 1 - begin), flat, off, names)
                    flat, off, begin = [], [0], at + 1
            if begin < b.num_rows:
                yield _rows(b.column(0).slice(begin), flat, off, names)

    schema = T.StructType([docs.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def _rows(ids: pa.Array, flat: list[int], off: list[int], names: list[str]) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(np.array(off, np.int32)), pa.array(np.array(flat, np.int32)))
    return pa.RecordBatch.from_arrays([ids, lists], names=names)


def with_counts(docs: DataFrame, text_col: str = "text", out: str = "n_tokens", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """The rows with the number of tokens of their text; 0 for a null or empty one."""
    sent = docs.sparkSession.sparkContext.broadcast(pack(name, folder))
    at = docs.columns.index(text_col)

    def run(batches):
        a = automaton(sent.value)
        for b in batches:
            n = [len(a.encode(t)) if t else 0 for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int32())], names=[*b.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.IntegerType())]))


def decoded(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id, text): the texts that token ids stand for, by emitting the labels of the arcs."""
    sent = tokens.sparkSession.sparkContext.broadcast(pack(name, folder))

    def run(batches):
        a = automaton(sent.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if i is None else a.decode(i) for i in b.column(1).to_pylist()], pa.string())], names=[id_col, "text"])

    return tokens.select(id_col, ids_col).mapInArrow(run, T.StructType([tokens.schema[id_col], T.StructField("text", T.StringType())]))

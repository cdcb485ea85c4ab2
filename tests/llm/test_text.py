"""Item pairs, tokens, packing and garbled text."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociq.llm import bpe, cooccurrence, garbled, packing


@pytest.mark.parametrize("chunk", [256, 2])
def test_associations(spark, chunk):
    r = random.Random(4)
    rows = [(f"b{r.randint(0, 30)}", f"i{min(r.randint(0, 20), r.randint(0, 20))}") for _ in range(300)] + [("huge", f"i{k}") for k in range(21)]
    rows += rows[:20] + [(None, "i1"), ("b1", None), ("single", "only")]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "x string, y string, n int, k int")
    baskets = defaultdict(set)
    for b, i in rows:
        if b is not None and i is not None:
            baskets[b].add(i)
    count, pairs = Counter(i for v in baskets.values() for i in v), Counter(p for v in baskets.values() for p in combinations(sorted(v), 2))
    got = {(x.a, x.b): (x.k, x.n_a, x.n_b, x.n) for x in cooccurrence.associations(df, F.col("x"), F.col("y"), chunk=chunk).collect()}
    assert got == {(a, b): (k, count[a], count[b], len(baskets)) for (a, b), k in pairs.items()}
    some = {(x.a, x.b) for x in cooccurrence.associations(df, F.col("x"), F.col("y"), 3, "0.2", 1, chunk).collect()}
    n = len(baskets)
    assert some == {(a, b) for (a, b), k in pairs.items() if k >= 3 and 5 * k >= n and k * n >= count[a] * count[b]}
    assert cooccurrence.associations(df.limit(0), F.col("x"), F.col("y")).count() == 0


TEXTS = [
    "Hello  world, don't we'll 'tis 12345 \n\n\t tab ", "", " ", "\r\n", "ГЕН найден 硫黄酸化に関わる", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "MKVLAAGIVGLLLSACDEFGHIKLMNPQRSTVWY" * 40,
    "🧬 done ✅", "ȩ́ ﬁ", "\x00\x01�", "===----!!!???", "<|endoftext|>", "x" * 20_000, "1" * 999 + "abc" * 999,
]


def reference_tokenizer(name):
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{bpe.TOKENIZERS}/{name}.tiktoken", "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k"])
def test_automaton_against_the_public_tokenizer(name):
    a, e = bpe.automaton(bpe.pack(name)), reference_tokenizer(name)
    r = random.Random(11)
    parts = ["ab", "aA ", "THE ", "0123456789", "éüа", "....--", "ACDEFGHIKLMNPQRSTVWY", "aeiou tnrs", "=*", "  \n", "日本語ゲノム"]
    texts = TEXTS + ["".join(r.choice(r.choice(parts)) for _ in range(r.randint(1, 60))) for _ in range(4000)]
    for t in texts:
        ids = a.encode(t)
        assert ids == e.encode_ordinary(t)
        assert a.decode(ids) == t


def test_every_arc_of_small_words():
    """All words of up to 4 letters of a small alphabet: every pair of their tokens is tried."""
    from itertools import product

    a, e = bpe.automaton(bpe.pack()), reference_tokenizer("byte_bpe_50k")
    for n in range(1, 5):
        for w in product("aehnrst", repeat=n):
            assert list(a.encode_word("".join(w).encode())) == e.encode_ordinary("".join(w))


def test_token_table(spark):
    rows = [(i, t, "x") for i, t in enumerate([*TEXTS, None])] + [(None, "a b", "x"), (0, TEXTS[0], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(2)
    e = reference_tokenizer("byte_bpe_50k")
    tokens = bpe.token_ids(df)
    got = Counter((r.doc_id, tuple(r.ids)) for r in tokens.collect())
    assert got == Counter((i, tuple(e.encode_ordinary(t or ""))) for i, t, _ in rows)
    back = {(r.doc_id, r.text) for r in bpe.decoded(tokens).collect()}
    assert back == {(i, t or "") for i, t, _ in rows}
    assert bpe.token_ids(df.limit(0)).count() == 0
    assert [r.n_tokens for r in bpe.with_counts(df.where("doc_id = 1")).collect()] == [0]


def packed(spark, docs, specs, **kw):
    items = spark.createDataFrame(docs, "doc_id long, text string, size int")
    s = spark.createDataFrame(specs, "spec_id int, capacity int")
    return items, s, packing.pack(items, s, "doc_id", "text", "size", **kw)


@pytest.mark.parametrize("shard", [4096, 60])
def test_packing_keeps_its_promises(spark, shard):
    r = random.Random(6)
    words = [f"word{i}" for i in range(40)]
    docs = [(i, " ".join(r.choices(words, k=r.randint(1, 30))), r.choice([0, 1, r.randint(1, 90), r.randint(1, 300)])) for i in range(300)] + [(900, None, 0), (901, "", None), (902, "dup", 5), (902, "dup", 5), (None, "n", 3)]
    items, specs, out = packed(spark, docs, [(1, 64), (2, 256)], shard_items=shard)
    rows = out.collect()
    for spec, capacity in ((1, 64), (2, 256)):
        own = [x for x in rows if x.spec_id == spec]
        room = Counter()
        for x in own:
            room[x.container] += x.tokens
        assert max(room.values()) <= capacity
        total = Counter()
        for x in own:
            total[x.id] += x.tokens
        want = Counter()
        for i, _, n in docs:
            want[i] += n or 0
        assert total == want and set(total) == {i for i, *_ in docs}
        for i, _, n in docs:
            pieces = [x for x in own if x.id == i]
            if (n or 0) <= capacity:
                assert len(pieces) == (2 if i == 902 else 1)
            else:
                assert sorted(p.piece for p in pieces) == list(range(-(-n // capacity)))
        least = -(-sum(want.values()) // capacity)
        assert len(room) <= 1.05 * least + 2 * (1 if shard > 300 else 6)
    usage = {u.spec_id: u.unused for u in packing.usage(out, specs).collect()}
    assert usage[1] >= 0 and usage[2] >= 0


def test_neighbours_go_together():
    texts = [f"{w} common text {w}x{i}" for w in ("alpha", "beta", "gamma") for i in range(8)]
    rows = packing.fill([10] * 24, packing.Index(texts), 80)
    boxes = defaultdict(set)
    for i, _, box, _ in rows:
        boxes[box].add(texts[i].split()[0])
    assert sorted(map(len, boxes.values())) == [1, 1, 1]


def test_packing_of_nothing_and_bad_specs(spark):
    assert packed(spark, [], [(1, 8)])[2].count() == 0
    assert packed(spark, [(1, "a", 3)], [])[2].count() == 0
    with pytest.raises(ValueError):
        packed(spark, [(1, "a", 3)], [(1, 0)])


CLEAN = [
    "Die Prüfung der größeren Blöcke läuft über Nacht.", "Le gène détecté à côté a été vérifié, reçu déjà.", "La anotación automática señaló más años aquí.", "A integração do operão será concluída amanhã.",
    "Белок короче порога и поэтому исключён из набора.", "硫黄酸化に関わる遺伝子群が検出された。", "Część sekwencji niższej jakości wymaga ręcznej korekty źródła.", "The “block” was at −80 °C; 5 µg ml⁻¹ – fine.",
    "ANOTAÇÃO DO GENOMA: NÃO usar", "√92 ≈ 89; ∆G′ Âge/âge 8; SÃO", "‹26› ¿3? ¡ok! ½ ¼ € £ © ®", "A shift of Å-scale", "plain text? yes", "É? Ü! “ß» naïve",
]


def damage(t):
    yield t.encode().decode("latin-1")
    yield "".join(chr(b) if b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode("cp1252") for b in t.encode())
    yield t.encode().decode("mac_roman")
    yield t.encode().decode("cp437")
    yield t.encode().decode("latin-1").encode().decode("latin-1")


def test_garbled_documents(spark):
    docs = [(i, t) for i, t in enumerate(CLEAN * 12)] + [(500, None), (501, ""), (502, "ascii only")]
    bad, origin = [], {}
    for t in CLEAN[:8]:
        for x in damage(t):
            origin[1000 + len(bad)] = t
            bad.append((1000 + len(bad), x))
    bad += [(2000, "Revisi�n de la anotaci�n"), (2001, "�"), (2002, CLEAN[4].encode("cp1251").decode("latin-1")), (2003, CLEAN[8].encode().decode("latin-1").encode("ascii", "ignore").decode() + " ANOTAÃ?Ã?O")]
    df = spark.createDataFrame([(*x, "w", 1) for x in docs + bad], "doc_id long, text string, word string, n int").repartition(3)
    found = {r.id for r in garbled.garbled(df).collect()}
    assert found == {i for i, _ in bad}
    back = {r.id: r.text for r in garbled.restored(df).collect()}
    assert set(back) == found
    right = [i for i, t in origin.items() if back[i] == t]
    assert len(right) >= 0.9 * len(origin)
    assert back[2000] == "Revisi�n de la anotación"
    assert back[2003].endswith("ANOTAÇÃO")
    assert garbled.garbled(df.limit(0)).count() == 0
    assert garbled.garbled(spark.createDataFrame([(1, "x")], "doc_id long, text string")).count() == 0


def model(words):
    """The letter and word model of a word table, built in this process."""
    pairs, singles, sketch = np.zeros(garbled.PAIRS, np.int64), np.zeros(garbled.SINGLES, np.int64), np.zeros(2 * garbled.WORDS, np.int64)
    for w, n in words.items():
        p, s = garbled._slots(np.frombuffer(f"\x02{w}\x02".encode("utf-32-le"), np.uint32))
        np.add.at(pairs, p, n)
        np.add.at(singles, s, n)
        i, j = garbled._word_slots(w)
        sketch[i] += n
        sketch[garbled.WORDS + j] += n
    return garbled.Letters(pairs, singles, sketch)


def test_word_frequencies_decide_among_ways_through_the_lattice():
    """Letter pairs alone would write ``niüo``, which no one did; the corpus has ``niño``."""
    m = model({"niño": 5, "iüa": 400, "biü": 400, "üo": 400, "güo": 300, "niä": 3})
    lost = "niÃ?o"  # the second byte of the letter is gone
    assert m.score("niüo") > m.score("niño") and m.likely("niño") > m.likely("niüo")
    assert garbled.undo_utf8(lost, "latin-1", m) == "niño"
    assert garbled.undo_utf8(lost, "latin-1", m, paths=1) in ("niño", "niüo")


def test_all_readings_of_lost_bytes_are_tried():
    """Three of four bytes are gone: 262,144 readings, of which the corpus knows one."""
    m = model({"a\U0001f600": 3, "é": 2})
    assert garbled._readings((0xF0, None, None, None), m) == ("\U0001f600",)
    assert garbled.undo_utf8("að???", "latin-1", m) == "a\U0001f600"


def test_a_huge_basket_is_cut_at_the_production_chunk(spark):
    rows = [("big", f"i{k:03}") for k in range(600)] + [(f"b{n}", f"i{k:03}") for n in range(3) for k in range(0, 30, n + 1)]
    df = spark.createDataFrame(rows, "x string, y string").repartition(3)
    got = {(r.a, r.b): r.k for r in cooccurrence.pair_counts(df.select(F.col("x").alias("basket"), F.col("y").alias("item"))).collect()}
    assert len(got) == 600 * 599 // 2
    assert got["i000", "i006"] == 4 and got["i000", "i003"] == 3 and got["i000", "i001"] == 2 and got["i598", "i599"] == 1

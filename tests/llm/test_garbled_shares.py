"""Swapped codecs where the damage is short, or too frequent for plain ratios."""

from lociq.llm import garbled

COMMON = ["Белок короче порога и исключён из набора", "Поиск не подтвердил ключевое слово", "Полнота сборки оценивается как высокая", "Загрязнение незначительно и учтено"]


def test_short_words_are_searched(spark):
    docs = [(i, f"kept at {i % 40} °C for a day") for i in range(200)]
    bad = [(900 + i, t.encode("cp1252").decode("mac_roman")) for i, (_, t) in enumerate(docs[:3])]
    df = spark.createDataFrame(docs + bad, "doc_id long, text string").repartition(3)
    assert {r.id for r in garbled.garbled(df).collect()} == {i for i, _ in bad}
    assert {r.id: r.text for r in garbled.restored(df).collect()} == {900 + i: t for i, (_, t) in enumerate(docs[:3])}


def test_a_garbled_third(spark):
    texts = [f"{COMMON[i % 4]}, {COMMON[i * 3 % 4]}. {COMMON[(i + 1) % 4]}" for i in range(90)]
    docs = [(i, t.encode("cp1251").decode("koi8-r") if i % 3 == 0 else t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert {r.id for r in garbled.garbled(df).collect()} == set(range(0, 90, 3))
    assert {r.id: r.text for r in garbled.restored(df).collect()} == {i: texts[i] for i in range(0, 90, 3)}

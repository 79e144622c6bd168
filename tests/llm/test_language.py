"""Language identification."""

import zlib

import numpy as np

from riskspark.llm import langid
from riskspark.llm.queries import QUERIES


def naive_phrases(learned, text):
    """Greedy longest matches, block by block, by searching the learned string."""
    symbols = langid._alphabet(learned)
    out = []
    for known in learned:
        source = symbols[np.frombuffer(known, np.uint8)].tobytes()
        count, raw = 0, symbols[np.frombuffer(text.lower().encode(), np.uint8)].tobytes()
        for start in range(0, len(raw), langid.BLOCK):
            block, at = raw[start : start + langid.BLOCK], 0
            while at < len(block):
                size = 0
                while at + size < len(block) and block[at : at + size + 1] in source:
                    size += 1
                count, at = count + 1, at + max(size, 1)
        out.append(count)
    return out


def test_phrases_equal_naive_parsing():
    model = langid.LanguageModel(("a", "b"), (b"the cat sat on the mat and the hat", b"der hund und die katze sind da"))
    texts = ["the cat", "der hund ist da", "qqq zzz", "the die the die", "x", "The CAT. And" * 60]
    counts, sizes = langid.phrases(model.tables(), texts)
    assert counts.tolist() == [naive_phrases(model.texts, t) for t in texts]
    assert sizes.tolist() == [len(t) for t in texts]


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "text")
    found = QUERIES["op10_language_id"](spark, folder).join(docs, "doc_id").collect()
    assert len(found) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.98
    assert all(0 <= r.score <= 1 for r in found)


def test_languages_of_long_documents_are_learned(spark):
    english, german, french = "the cat sat on the mat ", "der hund liegt auf dem boden ", "le chat dort sur la table "
    rows = [(i, english * 20, "en") for i in range(30)] + [(100 + i, german * (400 + i), "de") for i in range(6)]
    rows += [(200, french * 4000, "fr"), (201, "où " * 9, "xx"), (202, "zwölf boxkämpfer " * 600, "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.fit(docs)
    learned = dict(zip(model.languages, model.texts))
    assert set(learned) == {"de", "en", "fr", "xx"}
    assert learned["de"] == b"\n".join((german * n).encode() for n in (400, 401))
    assert learned["fr"] == (french * 4000).encode()[: langid.SAMPLE_BYTES]
    assert learned["xx"] == ("où " * 9 + "\n" + "zwölf boxkämpfer " * 600).encode()
    asked = spark.createDataFrame([("der hund liegt",), ("le chat dort",), ("the cat sat",)], "text string")
    assert [r.lang_pred for r in langid.identify(asked, model).collect()] == ["de", "fr", "en"]


def test_copies_of_a_key_leave_room_for_other_languages(spark):
    rows = [(1, f"the cat sat on mat {i}", "en") for i in range(5000)] + [(i, "der hund liegt", "de") for i in range(2, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model == langid.fit(docs.repartition(7)) and model.languages == ("de", "en")


def test_texts_that_no_language_explains(spark):
    learned = "the quick brown fox jumps over the lazy dog while other animals look on from afar " * 40
    model = langid.fit(spark.createDataFrame([(1, learned, "en")], "doc_id long, text string, lang string"))
    texts = {"the fox looks": True, "x": True, "zq": True, "съешь ещё этих мягких булок": False, "123": False, "": False, None: False}
    asked = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {r.text: r.explained for r in langid.identify(asked, model).collect()} == texts


def test_odd_rows(odd, empty):
    model = langid.fit(odd)
    out = langid.identify(odd, model).collect()
    assert len(out) == odd.count()
    for row in out:
        if row.text is None or not any(c.isalpha() for c in row.text):
            assert (row.lang_pred, row.score) == ("und", 0.0)
        else:
            assert row.lang_pred in model.languages and 0 < row.score <= 1
    assert langid.fit(empty).languages == ()
    assert {r.lang_pred for r in langid.identify(odd, langid.fit(empty)).collect()} == {"und"}
    assert langid.identify(empty, model).collect() == []


def test_tables_are_built_without_wide_copies():
    import random
    import tracemalloc

    draw = random.Random(5)
    texts = tuple("".join(draw.choices("abcdefghijklmnopqrstuvwxyzäöüßéèçñ .,", k=20_000)).encode() for _ in range(4))
    model = langid.LanguageModel(tuple("abcd"), texts)
    tracemalloc.start()
    tables = model.tables()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3.7 * tables.steps.nbytes

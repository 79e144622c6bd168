"""Small tables with every odd case: nulls in all columns, empty and long texts, ties, repeats, clashing names."""

import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, score string, "
    "component_id string, token_ids string, n_lines string, label int, number int, place int"
)


def row(doc_id, text, lang=None, source=None):
    return (doc_id, text, lang, source, len(text) if text else None, 7, 7, "x", "x", "x", "x", 7, 7, 7)


def odd_rows():
    draw = random.Random(5)
    words = ["the", "und", "la", "de", "Haus", "x", "1", "é", "漢字", "##"]
    long = " ".join(draw.choice(words) for _ in range(30_000))
    rows = [
        row(None, None), row(None, "no key here, but a text of some words", "en", "a"), row(0, None, "en", "a"),
        row(1, "", "en", None), row(2, " \n\t ", None, "b"), row(3, "123 456 !!", "de", "b"), row(4, long, "en", "a"),
        row(5, "one", "en", "c"), row(5, "one", "en", "c"), row(6, "ONE", "de", "a"), row(7, "one two three", "de", "b"),
        row(8, "w" * 20_000, "fr", "b"), row(9, long + " end", "en", "b"), row(9, "another text of nine", "en", "b"),
        row(10, "a\x0bb\x0cc\x1cd e f\u0000g", "es", "c"),
    ]
    for i in range(11, 60):
        rows.append(row(i, " ".join(draw.choice(words) for _ in range(draw.randint(0, 40))), draw.choice(["en", "de"]),
                        "a" if i % 3 else draw.choice(["b", "c", "d", None])))
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

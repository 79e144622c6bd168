"""The n-gram join against all pairs."""

import itertools
import random
import re

import pytest

from riskspark.llm import ngram_join
from riskspark.llm.graph import components


def all_pairs(rows, width, percent):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        whole = {tuple(words)} if words else set()
        sets.append({tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if len(words) >= width else whole)
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if rows[a][0] is None or rows[b][0] is None:
            continue
        shared = len(sets[a] & sets[b])
        linked = shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared)
        if linked or rows[a][0] == rows[b][0]:
            root[top(b)] = top(a)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[top(i)] = key if key is None else min(least.get(top(i), key), key)
    return sorted(((key, len(sets[i]), least[top(i)]) for i, (key, _) in enumerate(rows)), key=str)


def near_copies(count=250):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    base = [[draw.choice(words) for _ in range(draw.randint(1, 60))] for _ in range(9)]
    rows = []
    for key in range(count):
        text = list(base[0] if key % 3 == 0 else draw.choice(base))
        for _ in range(draw.randint(0, 3)):
            text[draw.randrange(len(text))] = draw.choice(words)
        rows.append((key, " ".join(text)))
    return rows


@pytest.mark.parametrize("width, percent, block", [(4, 85, 1024), (5, 80, 16), (1, 50, 1024)])
def test_equals_all_pairs(spark, monkeypatch, width, percent, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = ngram_join.similar_groups(docs, width=width, percent=percent).collect()
    assert sorted(map(tuple, found), key=str) == all_pairs(rows, width, percent)


def test_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    found = ngram_join.similar_groups(odd, width=4, percent=85).collect()
    assert sorted(map(tuple, found), key=str) == all_pairs(rows, 4, 85)
    assert ngram_join.similar_groups(empty).collect() == []


def test_one_per_group_keeps_columns_and_rows_without_key(odd, empty):
    kept = ngram_join.one_per_group(odd)
    assert kept.columns == odd.columns
    keys = [r.doc_id for r in kept.collect()]
    assert keys.count(None) == 2
    groups = ngram_join.similar_groups(odd).where("doc_id IS NOT NULL").collect()
    assert sorted(k for k in keys if k is not None) == sorted({r.component_id for r in groups})
    assert ngram_join.one_per_group(empty).collect() == []


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 100), (200, 101), (102, 200), (7, 3), (7, 3)]
    found = {r.node: r.component for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(1, 61)}, 200: 101, 102: 101}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []

"""Mixing sources."""

import re

import numpy as np
import pytest

from riskspark.llm import mixing


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 65, 1000])
def test_permutation(size):
    for key in (0, 5, 2**63 - 1):
        index = np.arange(size)
        moved = mixing.permuted(index, np.full(size, size), np.full(size, key).astype(np.uint64))
        assert sorted(moved.tolist()) == index.tolist()
    if size >= 64:
        assert moved.tolist() != index.tolist()


def targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    whole, full = sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        level = (whole - sum(most * sizes[s] for s in full)) / max(sum(weight[s] for s in rest), 1)
        over = {s for s in rest if most * sizes[s] <= level * weight[s]}
        if not over:
            return {s: most * sizes[s] if s in full else level * weight[s] for s in names}
        full |= over


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("block", [1024, 8])
def test_targets_and_whole_results(odd, block):
    rows = [(r.doc_id, len(words_of(r.text)), r.source) for r in odd.collect()]
    sizes = {}
    for _, size, source in rows:
        sizes[source] = sizes.get(source, 0) + size
    mix = mixing.mix_sources(odd, block_words=block)
    found = mixing.taken_per_document(mix).collect()
    assert sorted((str(r.doc_id), r.size) for r in found) == sorted((str(i), n) for i, n, _ in rows)
    assert all(0 <= r.taken <= 3 * r.size for r in found)
    known = {r.source: r for r in mix.sources.collect()}
    want = targets(sizes)
    taken = {r.number: r.words for r in mix.slots.groupBy("number").sum("words").withColumnRenamed("sum(words)", "words").collect()}
    for source, target in want.items():
        row = known[source]
        assert row.source_size == sizes[source] and abs(row.target - target) < 1e-6 * max(target, 1)
        assert abs(taken.get(row.number, 0) - target) <= 0.5
    assert sum(r.taken for r in found) == sum(taken.values())
    again = mixing.taken_per_document(mixing.mix_sources(odd.repartition(5), block_words=block)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


def test_slots_take_each_block_once_a_pass(odd):
    mix = mixing.mix_sources(odd, block_words=16)
    slots = mix.slots.toPandas()
    assert not slots.duplicated(["number", "pass", "block"]).any() and not slots.duplicated(["number", "slot"]).any()
    assert (slots["words"] > 0).all() and slots["shard"].between(0, mixing.SHARDS - 1).all()


def test_mixed_documents_hold_the_words_taken(odd, empty):
    once = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"])
    mix = mixing.taken_per_document(mixing.mix_sources(once, block_words=16)).collect()
    out = mixing.mixed_documents(once, block_words=16)
    assert out.columns == odd.columns
    texts, words = {}, {}
    for r in once.collect():
        texts.setdefault(r.doc_id, []).append(words_of(r.text))
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(words_of(r.text))
        assert any(set(words_of(r.text)) <= set(t) for t in texts[r.doc_id])
    taken = {}
    for r in mix:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    assert words == {k: n for k, n in taken.items() if n}
    assert mixing.mixed_documents(empty).collect() == []
    assert mixing.taken_per_document(mixing.mix_sources(empty)).collect() == []

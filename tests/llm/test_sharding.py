"""Interleaved shards against sorting everything."""

import hashlib
import zlib
from collections import Counter

import pytest

from riskspark.llm import common, sharding


def expected(rows, shards):
    groups = {}
    for doc_id, text, source in rows:
        raw = (text or "").encode()
        draw = hashlib.md5(f"{sharding.SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        key = (draw, -1 if doc_id is None else doc_id, zlib.crc32(raw), len(raw) + 1)
        groups.setdefault(source, []).append((key, doc_id))
    placed = []
    for source, members in groups.items():
        for rank, (key, doc_id) in enumerate(sorted(members, key=lambda m: m[0])):
            placed.append(((rank + 0.5) / len(members), source is None, source or "", doc_id, key[3], key[2], source))
    placed.sort(key=lambda p: p[:3])
    total, out = len(placed), []
    for place, (_, _, _, doc_id, size, crc, source) in enumerate(placed):
        shard = place * shards // total
        out.append((doc_id, source, size, crc, shard, place - -(-shard * total // shards)))
    return sorted(out, key=str)


@pytest.mark.parametrize("shards, bucket", [(8, 8192), (3, 4), (100, 4), (1, 8192)])
def test_equals_sorting(monkeypatch, odd, shards, bucket):
    monkeypatch.setattr(common, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(common, "FAN", 4)
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    found = sharding.interleaved_shards(odd, shards=shards)
    assert sorted(map(tuple, found.collect()), key=str) == expected(rows, shards)


def test_shards_match_the_mixture(spark):
    docs = spark.range(5000).selectExpr(
        "id AS doc_id", "'x' AS text", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 7) END AS source")
    rows = sharding.interleaved_shards(docs).collect()
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1
    for source, total in Counter(r.source for r in rows).items():
        for shard in range(8):
            assert abs(sum(r.source == source and r.shard == shard for r in rows) - total / 8) <= 2
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s])) for s in counts)


def test_sources_of_one_row_spread_over_windows(spark, monkeypatch):
    stored = []

    def kept(df, name):
        stored.append((name, cut(df, name)))
        return stored[-1][1]

    cut = common.cut_lineage
    monkeypatch.setattr(common, "cut_lineage", kept)
    monkeypatch.setattr(sharding, "cut_lineage", kept)
    monkeypatch.setattr(common, "BUCKET_ROWS", 100)
    rows = [(i, "x", f"s{i * 7919 % 4001}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(map(tuple, sharding.interleaved_shards(docs).collect()), key=str) == expected(rows, 8)
    name, column = ("ranges", "__part") if stored[-1][0] == "ranges" else ("ranked", "slice")
    windows = [r["count"] for r in dict(stored)[name].groupBy(column).count().collect()]
    assert max(windows) < 1000 and sum(windows) == 4000


def test_empty_table(empty):
    assert sharding.interleaved_shards(empty).collect() == []


def test_main_path_is_native(odd):
    plan = sharding.interleaved_shards(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan

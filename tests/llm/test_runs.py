"""Runs of words against a search of every period, on small texts of few words."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from riskspark.llm import factors, periodic_runs
from riskspark.llm.queries import QUERIES


def all_runs(words):
    """(start, length, period) of each run, by trying every period at every place."""
    out = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            stretch = words[i : j + q]
            smaller = any(stretch[p:] == stretch[:-p] for p in range(1, q))
            if j > i and len(stretch) >= max(6, 4 * q) and not smaller:
                out.append((i, len(stretch), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def expected(words):
    runs = all_runs(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    milli = 1000 * best[1] // best[2] if runs else None
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (len(runs), *best, milli, hashlib.sha256(listed.encode()).hexdigest(),
            hashlib.sha256(collapsed(words, runs).encode()).hexdigest())


def found(texts):
    columns = periodic_runs.runs_of(pa.array(texts, pa.string()))
    runs = [[(r["start"], r["length"], r["period"]) for r in x] for x in columns[5].to_pylist()]
    return runs, columns[6].to_pylist()


def split(text):
    return [w for w in (text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.tuples(st.text("abc", min_size=1, max_size=5), st.integers(1, 7)), max_size=5), max_size=6))
def test_runs_of_repeated_pieces(texts):
    texts = [" ".join(" ".join(piece * times) for piece, times in pieces) for pieces in texts]
    runs, left = found(texts)
    for text, own, rest in zip(texts, runs, left):
        assert own == all_runs(text.split())
        assert rest == collapsed(text.split(), own)


def test_overlapping_runs_of_two_periods():
    words = list("abab" * 3 + "ab" + "b" * 9 + "xyzw" * 5 + "xy")
    runs, _ = found([" ".join(words)])
    assert runs[0] == all_runs(words) and len(runs[0]) == 3


def test_long_texts():
    draw = random.Random(3)
    base = [str(draw.randrange(10**9)) for _ in range(3000)]
    texts = ["a " * 50_000, " ".join(base * 5 + base[:17]), "\t".join(base)]
    runs, left = found(texts)
    assert runs == [[(0, 50_000, 1)], [(0, 15_017, 3000)], []]
    assert left == ["a", " ".join(base), " ".join(base)]


def test_levels_name_equal_factors_alike():
    draw = random.Random(9)
    texts = [[draw.choice("ab") for _ in range(draw.randint(0, 60))] for _ in range(20)]
    words = factors.split_words(pa.array([" ".join(t) for t in texts]))
    for level in factors.levels(words):
        seen = {}
        for place, name in zip(level.places.tolist(), level.names.tolist()):
            text = int(np.searchsorted(words.starts, place, side="right")) - 1
            at = place - words.starts[text]
            assert at + level.length <= len(texts[text])
            seen.setdefault((text, tuple(texts[text][at : at + level.length])), set()).add(name)
        assert all(len(names) == 1 for names in seen.values())
        assert len(set().union(*seen.values())) == len(seen)


def looped(key, words):
    check = zlib.crc32(str(key).encode())
    if key is None or check % 10 or not words:
        return words
    a = check // 10 % len(words)
    p = 1 + (len(words) - a) // (3 + check // 10 % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]


def test_odd_documents(spark, odd, empty):
    out = periodic_runs.digests(periodic_runs.periodic_runs(odd))
    want = sorted((str(r.doc_id), *map(str, expected(split(r.text)))) for r in odd.select("doc_id", "text").collect()
                  if len(split(r.text)) < 1000)
    rows = out.collect()
    assert len(rows) == odd.count()
    short = [r for r in rows if len(split(r.text)) < 1000]
    assert sorted((str(r.doc_id), *map(str, (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256,
                                            r.collapsed_sha256))) for r in short) == want
    assert "number" in out.columns and out.columns.count("n_runs") == 1
    assert periodic_runs.periodic_runs(empty).collect() == []


def test_query_over_odd_documents(odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op11_periodic_runs"](odd.sparkSession, str(tmp_path)).collect()
    texts = [(r.doc_id, split(r.text)) for r in odd.select("doc_id", "text").collect()]
    want = sorted(map(str, ((key, *expected(looped(key, words))) for key, words in texts if len(words) < 1000)))
    got = {str(tuple(r)) for r in rows}
    assert len(rows) == len(texts) and set(want) <= got
    assert any(looped(key, words) != words for key, words in texts)

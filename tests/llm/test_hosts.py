"""Measures by counting, the prior by its moments, and verdicts of hosts."""

import collections

import numpy as np
import pytest

from riskspark.llm import host_rules
from riskspark.llm.queries import QUERIES
from test_runs import split


def counted(text):
    words = split(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if split(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_measures(spark, odd, empty):
    again = "a b c d e f g h i j"
    texts = [again, f"{again} {again}", "a " * 9, "x\nx\n\n \nx \nx", "## ** $ % & | < >", "é漢 🙂", f"{again}\n" * 3 + "z"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").unionByName(
        odd.select("doc_id", "text"))
    for r in host_rules.measure(rows).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counted(r.text)
    assert host_rules.measure(empty).collect() == []
    with pytest.raises(ValueError):
        host_rules.measure(rows, window=6)


def hosts(spark, rows):
    return spark.createDataFrame(rows, "host string, documents long, failed long")


def test_prior_finds_the_distribution_that_rates_were_drawn_from(spark):
    draw = np.random.default_rng(4)
    rates = draw.beta(4, 16, 3000)
    sizes = draw.integers(5, 400, 3000)
    rows = [(str(i), int(n), int(draw.binomial(n, p))) for i, (n, p) in enumerate(zip(sizes, rates))]
    prior = host_rules.fit_prior(hosts(spark, rows))
    assert abs(prior.mean - 0.2) < 0.01 and 17 < prior.weight < 23


def test_prior_of_few_or_equal_hosts(spark):
    low, high = host_rules.PRIOR_WEIGHTS
    assert host_rules.fit_prior(hosts(spark, [])) == host_rules.Prior(0.0, high)
    assert host_rules.fit_prior(hosts(spark, [("a", 10, 5)])) == host_rules.Prior(0.5, high)
    assert host_rules.fit_prior(hosts(spark, [("a", 10, 0), ("b", 5, 0)])) == host_rules.Prior(0.0, high)
    assert host_rules.fit_prior(hosts(spark, [("a", 100, 50), ("b", 100, 50)])).weight == high
    assert host_rules.fit_prior(hosts(spark, [("a", 1000, 0), ("b", 1000, 1000)])).weight == low


def measured(spark, rows):
    """(source, documents, of them short) as measured documents."""
    docs = []
    for source, n, bad in rows:
        docs += [(len(docs) + i, source, 5 if i < bad else 100) for i in range(n)]
    return spark.createDataFrame(
        [(i, s, n, 5 * n, 0, 0, 0) for i, s, n in docs],
        "doc_id long, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")


def test_a_bad_host_takes_its_documents_and_a_small_one_is_shrunk(spark):
    ordinary = [(f"s{i}", 60 + i, 4 + i % 5) for i in range(12)]
    table = measured(spark, [*ordinary, ("bad", 50, 46), ("one", 1, 1), ("two", 2, 1), (None, 3, 1)])
    verdicts = host_rules.host_verdicts(table)
    found = {r.host: r for r in verdicts.collect()}
    assert found["bad"].refused and found["bad"].failed_short == 46
    assert not any(r.refused for name, r in found.items() if name != "bad")
    assert found["one"].shrunk_rate < 0.5 and None not in found
    kept = host_rules.judge(table, verdicts).groupBy("source").sum("n_words").collect()
    assert len(kept) == 16
    judged = host_rules.judge(table, verdicts).collect()
    assert len(judged) == table.count()
    for r in judged:
        assert r.base_failed == (r.n_words < 20)
        assert r.kept == (not r.base_failed and r.source != "bad")


def test_query_over_odd_documents(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op13_host_rules"](spark, str(tmp_path)).collect()
    want = collections.Counter((r.doc_id, *counted(r.text)) for r in odd.select("doc_id", "text").collect())
    assert collections.Counter(tuple(r)[:6] for r in rows) == want
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in rows)
    assert not any(r.kept and r.base_failed for r in rows)


def test_no_documents(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["op13_host_rules"](spark, str(tmp_path)).collect() == []
    assert QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect() == []

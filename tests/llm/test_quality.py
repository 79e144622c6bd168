"""The factorisation machine."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from riskspark.llm import quality_fm
from riskspark.llm.queries import QUERIES


def test_linear_time_equals_all_pairs():
    rng = np.random.default_rng(0)
    machine = quality_fm.Machine(0.3, rng.normal(size=quality_fm.INPUTS), rng.normal(size=(quality_fm.INPUTS, 8)))
    texts = pa.array(["one two two THREE!", "", None, "x | y | 12", "é " * 50])
    rows, inputs, values = quality_fm.inputs_of(texts, np.array([3.0, np.nan, 0, 5, 1e6]))
    found = quality_fm.margins(machine, rows, inputs, values, 5)
    for i in range(5):
        own, weight = inputs[rows == i], values[rows == i]
        expected = machine.bias + sum(machine.weights[a] * x for a, x in zip(own, weight))
        for p in range(len(own)):
            for q in range(p):
                expected += machine.factors[own[p]] @ machine.factors[own[q]] * weight[p] * weight[q]
        assert abs(found[i] - expected) < 1e-9


def test_learns_a_pairwise_rule():
    rng = np.random.default_rng(1)
    samples, labels = [], []
    for _ in range(1500):
        a, b = rng.integers(0, 2, 2)
        samples.append((np.array([a, 10 + b]), np.ones(2)))
        labels.append(float(a == b))
    machine = quality_fm.train(samples, np.array(labels))
    rows = np.repeat(np.arange(len(samples)), 2)
    margin = quality_fm.margins(machine, rows, np.concatenate([s[0] for s in samples]), np.ones(len(rows)), len(samples))
    assert np.mean((margin > 0) == np.array(labels)) > 0.95


def test_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    found = QUERIES["op2_quality_fm"](spark, folder)
    assert found.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    rows = found.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) / len(held) >= 0.95


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame(
        [(4, 1), (4, 1), (6, 0), (7, None), (999, 1), (None, 1), (5, 0), (9, 1)], "doc_id long, quality int")
    machine = quality_fm.fit(odd, labels)
    out = quality_fm.score(odd, machine)
    assert out.count() == odd.count() and out.where("score IS NULL OR score NOT BETWEEN 0 AND 1").count() == 0
    assert out.columns == [c for c in odd.columns if c != "score"] + ["score", "predicted"]
    assert quality_fm.score(empty, machine).collect() == []
    none = quality_fm.fit(odd, labels.limit(0))
    assert {r.score for r in quality_fm.score(odd, none).collect()} == {0.5}


def test_a_key_of_many_documents_is_one_example(spark, monkeypatch):
    rows = spark.range(3000).select((F.col("id") % 2).alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 700).alias("text"))
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    seen, train = [], quality_fm.train
    monkeypatch.setattr(quality_fm, "train", lambda samples, labels: seen.append(len(samples)) or train(samples, labels))
    one, two = quality_fm.fit(rows.repartition(5), labels), quality_fm.fit(rows, labels)
    assert seen == [2, 2] and np.array_equal(one.weights, two.weights)

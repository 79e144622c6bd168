"""The pipeline, and each stage on the output of the one before."""

import numpy as np
import pytest

import corpus_pipeline
from riskspark.llm import langid, line_dedup, mixing
from test_join import all_pairs
from test_lines import expected as without_boilerplate
from test_tokens import LIBRARY


@pytest.fixture(scope="module")
def stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], folder).cache())
    yield out
    for df in out[1:]:
        df.unpersist()


def test_stages_return_documents(stages):
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "language ID"


def test_language_stage_keeps_what_a_language_explains(stages):
    """Clean documents all stay, each under the language found; what has no letter goes."""
    named = stages[0].where(langid.training_rows())
    found = langid.identify(stages[0], langid.fit(named)).collect()
    want = [(r.doc_id, r.text, r.source, r.lang_pred) for r in found if any(c.isalpha() for c in r.text or "")]
    after = [(r.doc_id, r.text, r.source, r.lang) for r in stages[1].collect()]
    assert sorted(after) == sorted(want)


def test_language_stage_rejects_what_no_language_explains(spark, folder, stages):
    docs, names = stages[0], ["doc_id", "text", "lang", "source", "n_chars"]
    strange = [(10**9, "съешь ещё этих мягких французских булок " * 9), (10**9 + 1, "我能吞下玻璃而不伤身体" * 9)]
    more = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in strange], ",".join(f"{n} {dict(docs.dtypes)[n]}" for n in names))
    kept = corpus_pipeline.language_id(spark, docs.select(names).unionByName(more), folder)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in stages[1].collect())


def test_line_stage(stages):
    rows = [(r.doc_id, r.text, r.source) for r in stages[1].collect()]
    want = [(i, t) for i, t, _, gone in without_boilerplate(rows, line_dedup.MIN_SITES) if not gone or t.strip()]
    found = stages[2].collect()
    assert sorted((r.doc_id, r.text) for r in found) == sorted(want)
    assert all(r.n_chars == len(r.text) for r in found)


def test_near_duplicate_stage(stages):
    groups = all_pairs([(r.doc_id, r.text) for r in stages[2].collect()], 5, 80)
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted({component for _, _, component in groups})


def test_mixing_stage(stages):
    taken = mixing.taken_per_document(mixing.mix_sources(stages[3])).where("taken > 0").collect()
    words = {}
    for r in stages[4].collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == {r.doc_id: r.taken for r in taken}


def test_token_stage_and_run(spark, folder, stages):
    texts = sorted((r.doc_id, LIBRARY.encode_ordinary(r.text)) for r in stages[4].collect())
    found = sorted((r.doc_id, np.frombuffer(r.token_ids, "<u4").tolist()) for r in stages[5].collect())
    assert found == texts
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, np.frombuffer(r.token_ids, "<u4").tolist()) for r in whole) == texts


def test_a_task_holds_one_vocabulary(spark, folder):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    plan = corpus_pipeline.tokens(spark, docs, folder)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_a_worker_holds_what_one_operator_learned():
    """A worker that encodes after naming languages has given up their tables."""
    import gc
    import weakref

    import public_tokenizers

    from riskspark.llm import bpe

    model = langid.LanguageModel(("en", "fr"), (b"the cat sat on the mat", b"le chat sur le tapis"))
    tables = weakref.ref(model.tables())
    assert model.tables() is tables()
    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as file:
        ranks = file.read()
    codec = weakref.ref(bpe.codec(ranks, public_tokenizers.PATTERN))
    gc.collect()
    assert tables() is None and bpe.codec(ranks, public_tokenizers.PATTERN) is codec()
    model.tables()
    gc.collect()
    assert codec() is None


def test_odd_documents_pass(spark, folder, odd, empty):
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() > 0
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.collect() == []

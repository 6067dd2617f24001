"""The pipeline's stages one after another, against plain Python and the tokenizer library."""

import collections

import numpy as np
import pytest
from test_corpus_operators import ODD, brute_groups, library, odd_docs  # noqa: F401

import corpus_pipeline
from stareflow.llm import bpe, mixing, ngram_join, quality, secrets


@pytest.fixture(scope="module")
def ran(spark, sf):
    return corpus_pipeline.run(spark, sf).collect()


def test_run_equals_the_stages_in_plain_python(spark, sf, ran, library):  # noqa: F811
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    found = {r.doc_id: quality.measures(r.text) for r in docs}
    patterns, counts = np.unique([quality.vote(f) for f in found.values()], return_counts=True)
    good = dict(zip(patterns.tolist(), quality.posterior(patterns, *quality.fit(patterns, counts.astype(float))), strict=True))
    kept = [r for r in docs if found[r.doc_id]["n_words"] >= 50 and 100 * found[r.doc_id]["n_repeat_words"] <= 50 * found[r.doc_id]["n_words"] and good[quality.vote(found[r.doc_id])] >= quality.KEEP]
    groups = brute_groups([(r.doc_id, r.text) for r in kept])
    kept = [r for r in kept if groups[r.doc_id][1] == r.doc_id]
    words = secrets.words()
    text = {r.doc_id: secrets.masked(r.text, secrets.find(r.text, words)) for r in kept}
    size = {i: len(t.encode().split()) for i, t in text.items()}
    source = {r.doc_id: r.source for r in kept}
    total = collections.Counter()
    for i, n in size.items():
        total[source[i]] += n
    names = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    goal = mixing.targets(np.array([total[s] for s in names]), np.array([mixing.WEIGHTS[k % 3] for k in range(len(names))], float))
    times = collections.Counter(r.doc_id for r in ran)
    assert set(times) <= set(text) and len(text) > 50
    for s, t in zip(names, goal, strict=True):
        own = [i for i in text if source[i] == s]
        base = int(t) // total[s]
        assert {times[i] for i in own} <= {base, base + 1}
        assert abs(sum(times[i] * size[i] for i in own) - t) <= max(size[i] for i in own) / 2 + 2
    for r in ran:
        assert list(r.ids) == library.encode_ordinary(text[r.doc_id])


def test_stages_keep_columns_and_take_odd_and_empty_tables(spark):
    odd = odd_docs(spark)
    none = odd.limit(0)
    good = " ".join(f"alpha{chr(97 + i)} the beta{chr(97 + i)} of gamma{chr(97 + i)}" for i in range(26)) + ". "
    more = spark.createDataFrame([(1, good, "s", "x", 9), (None, good, None, "y", 9), (1, good + "token: xK9vQ2mZ7wRt", "s", "x", 9), (7, good, "s", "x", 9)], odd.schema)
    df = odd.unionByName(more)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, "")
        assert out.columns == df.columns and stage(spark, none, "").count() == 0
    texts = lambda d: sorted((r.doc_id or 0, r.text or "", r.source or "", r.size) for r in d.collect())
    kept = quality.good_documents(spark, df, "")
    assert texts(kept) == texts(more)
    assert texts(ngram_join.one_of_each_group(spark, more, "")) == [(1, good, "s", "x")]  # of rows linked with each other one stays
    clean = secrets.without_secrets(spark, df, "").collect()
    assert len(clean) == df.count() and not any("xK9vQ2mZ7wRt" in (r.text or "") for r in clean)
    assert sum(r.text is None for r in clean) == 2 * sum(t is None for t in ODD)
    mixed = mixing.mixed_documents(spark, more.unionByName(more), "").collect()
    assert collections.Counter(r.source for r in mixed).keys() == {"s", None}
    ids = bpe.token_ids(spark, more, "")
    assert sorted(r.doc_id or 0 for r in ids.collect()) == [0, 1, 1, 7] and bpe.token_ids(spark, none, "").count() == 0

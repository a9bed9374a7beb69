"""The pipeline's stages in their order, and a brute-force view of each on its own input."""

import re

import corpus_pipeline
from skygauge.llm import pii, rules
from skygauge.llm.storage import land, table
from skygauge.llm.text import shingle_hashes, words

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "pii", "mixing", "best_fit_packing"]
    docs = table(spark, SMALL, "documents")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(land(stage(spark, kept[-1], SMALL), name))
        if name != "best_fit_packing":
            assert kept[-1].dtypes == docs.dtypes
    raw, ruled, single, masked, mixed, packed = (k.toPandas() for k in kept)
    assert 0 < len(ruled) < len(raw) and not any(rules.base_failed(c[0], c[4]) for c, _ in map(rules.base_counts, ruled.text))
    sets = [set(shingle_hashes(words(t)).tolist()) for t in single.text]
    assert not any(5 * len(a & b) >= 4 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    gone = ruled[~ruled.doc_id.isin(single.doc_id)]
    assert single.doc_id.is_unique and len(gone) + len(single) == len(ruled)
    assert set(masked.doc_id) == set(single.doc_id) and not any(pii.base_spans(t) for t in masked.text) and (masked.n_chars == masked.text.str.len()).all()
    assert not any(re.search(r"\w@\w+\.", t) for t in masked.text)
    assert set(mixed.doc_id) <= set(masked.doc_id) and mixed.groupby("doc_id").size().max() <= 3
    assert set(packed.doc_id) == set(mixed.doc_id) and packed.groupby("sequence_id").length.sum().max() <= 1024


def test_run_equals_stages(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0 and corpus_pipeline.ORACLE_SQL is None

"""The pipeline against the operators' plain versions, one after the other."""

from __future__ import annotations

import public_tokenizers
import test_line_dedup
import test_packing
import test_quality
import test_simhash

import corpus_pipeline
from tracewright.llm import line_dedup, toxicity
from tracewright.session import table


def test_pipeline(spark, sf):
    docs = table(spark, sf, "documents")
    toxic = {r.doc_id for r in toxicity.assess(docs, table(spark, sf, "labels")).where("predicted = 1").collect()}
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect() if r.doc_id not in toxic]
    good = {r[0] for r in test_quality.brute([r[:3] for r in rows]) if r[-1]}
    cleaned = test_line_dedup.brute([(d, s, t) for d, t, _, s in rows if d in good], line_dedup.RATIO, line_dedup.LEAST_PAGES)
    texts = [(r[0], r[2]) for r in cleaned]
    kept = test_simhash.brute_kept(texts)
    assert 0 < len(kept) < len(texts) < docs.count()
    test_packing.verify(kept, corpus_pipeline.run(spark, sf).collect())


def test_stages_keep_the_columns(spark, sf):
    docs = table(spark, sf, "documents")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "line_dedup", "near_dedup", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).dtypes == docs.dtypes
    assert public_tokenizers.path(corpus_pipeline.WORD_BPE)

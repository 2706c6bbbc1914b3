"""The pipeline's stages: what they keep, what they drop, and that their columns stay."""

import os

import pytest

import corpus_pipeline
from quarrylight.llm import tokens

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.write.parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}")
        docs = spark.read.parquet(path)
        kept.append(docs.count())
    assert kept[0] > kept[1] >= kept[2] == kept[3]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    lengths = {i: 0 for i in (r.doc_id for r in packed)}
    for r in packed:
        lengths[r.doc_id] += r.length
    encoder = tokens.encoder().tokenizer
    assert lengths == {r.doc_id: len(encoder.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect()}

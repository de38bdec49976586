"""The pipeline's stages, one after another, against what each must do."""

import corpus_pipeline
import pytest
from pagemark.llm import pii, quality_rules, simhash, toxicity

from .test_operators import DOCS, labelled_docs, words


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    docs, labels = labelled_docs(spark, 400)
    more = spark.createDataFrame([(9000, "short", "en", "a", 5), (9001, None, None, None, None), (9002, words(100, 1) + " me@x.org", "en", "a", 0), (9003, words(100, 1) + " me@x.org", "en", "a", 0)], DOCS)
    docs.union(more).write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, before, folder).collect(), before.schema)
        ids, old = ({r.doc_id for r in x.collect()} for x in (after, before))
        assert after.columns == docs.columns and ids <= old
        if name == "quality_rules":
            assert ids == {r.doc_id for r in quality_rules.quality_rules(before).where("kept").collect()} and 9000 not in ids and 9001 not in ids
        if name == "toxicity":
            labels = spark.read.parquet(f"{folder}/labels.parquet")
            assert ids == {r.doc_id for r in toxicity.toxicity_scores(before, labels).where("score < 0.7").collect()}
        if name == "simhash_dedup":
            assert ids == {r.component_id for r in simhash.simhash_groups(before).collect()} and 9002 in ids and 9003 not in ids
        if name == "pii":
            texts = {r.doc_id: r.text for r in before.collect()}
            assert all(r.text == pii.redact(texts[r.doc_id]) for r in after.collect())
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, folder).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in before.collect()}
    whole = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in whole} == {r.doc_id for r in packed} and sum(r.length for r in whole) == sum(r.length for r in packed)

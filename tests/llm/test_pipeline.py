"""The pipeline against plain versions of its stages."""

import statistics

import brute
import corpus_pipeline
import public_tokenizers
import pytest
from terrapane.llm import classifier
from terrapane.llm.common import materialize


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {"documents": docs}
    for name, f in corpus_pipeline.STAGES:
        docs = out[name] = materialize(f(spark, docs, sf), name)
    return out


def test_stages_keep_the_columns_of_documents(stages):
    want = stages["documents"].columns
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name].columns == want


def test_quality_stage_drops_what_the_classifier_rejects(spark, sf, stages):
    kept = classifier.posteriors(stages["documents"], spark.read.parquet(f"{sf}/labels.parquet")).where("kept")
    assert {r.doc_id for r in stages["quality"].collect()} == {r.doc_id for r in kept.collect()}


def test_near_duplicate_stage_keeps_one_of_each_group(stages):
    texts = {r.doc_id: r.text for r in stages["quality"].collect()}
    assert {r.doc_id for r in stages["near_duplicates"].collect()} == set(brute.components(texts).values())


def test_no_secret_is_left(stages):
    assert stages["redact_secrets"].count() == stages["near_duplicates"].count()
    assert all(brute.secrets(r.text)[:3] == (0, 0, 0) for r in stages["redact_secrets"].collect())


def test_mix_meets_targets(stages):
    size = lambda rows: {s: sum(len(brute.WORD.findall(r.text)) for r in rows if r.source == s) for s in {r.source for r in rows}}
    middle = lambda rows, s: statistics.median(len(brute.WORD.findall(r.text)) for r in rows if r.source == s)
    rows = stages["redact_secrets"].collect()
    before, after = size(stages["redact_secrets"].collect()), size(stages["mix_sources"].collect())
    for s, t in brute.mix_targets(before).items():
        assert abs(after.get(s, 0) - t) <= 0.005 * t + middle(rows, s) / 2


def test_tokens_decode_to_the_texts(stages):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = stages["encode_tokens"].collect()
    assert sorted(r.text for r in rows) == sorted(r.text for r in stages["mix_sources"].collect())
    assert all(r.ids == library.encode(r.text, add_special_tokens=False).ids for r in rows)


def test_run_gives_the_last_stage(spark, sf, stages):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.text) for r in rows) == sorted((r.doc_id, r.text) for r in stages["encode_tokens"].collect())

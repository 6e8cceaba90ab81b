"""The pipeline's stages against plain restatements of what they decide."""

from collections import Counter

import pytest

import corpus_pipeline
from chronolex.llm import language_id, mixing
from chronolex.llm.common import stored

from .corpus import awkward, empty
from .test_brute_force import base_spans, check_packing, plain_components, plain_simhash


def test_stages(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "secret_scan", "mixing", "best_fit_packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)

    kept = stored(stage["language_id"](spark, docs, sf), "t1")
    rejected = {r.doc_id for r in language_id.identify(docs, language_id.learn(docs)).where("rejected").collect()}
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - rejected
    assert len(rejected) < 0.01 * docs.count()

    single = stored(stage["simhash_dedup"](spark, kept, sf), "t2")
    roots = plain_components([(r.doc_id, plain_simhash(r.text)) for r in kept.collect()])
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == sorted(i for i, r in roots.items() if i == r)

    masked = stored(stage["secret_scan"](spark, single, sf), "t3")
    before = {r.doc_id: r for r in single.collect()}
    assert masked.columns == columns and masked.count() == single.count()
    for r in masked.collect():
        old = before[r.doc_id]
        if not base_spans(old.text) and "[secret]" not in r.text:
            assert r == old
        assert not base_spans(r.text) and r.n_chars == len(r.text)
        for kind, a, b in base_spans(old.text):
            assert old.text[a:b] not in r.text

    mixed = stored(stage["mixing"](spark, masked, sf), "t4")
    rates = mixing.mix(masked, mixing.domains(spark.read.parquet(f"{sf}/labels.parquet")), mixing.TARGETS).collect()
    assert mixed.columns == columns and sorted(r.doc_id for r in mixed.collect()) == sorted(r.doc_id for r in rates for _ in range(r.copies))
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    clean = [r.copies for r in rates if r.doc_id in labels and labels[r.doc_id].quality == 1 and labels[r.doc_id].toxic == 0]
    assert sum(c >= 1 for c in clean) > 0.97 * len(clean)

    packed = stage["best_fit_packing"](spark, mixed, sf).collect()
    check_packing(packed, 2048)
    assert {r.doc_id for r in packed} == {r.doc_id for r in mixed.collect()}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
@pytest.mark.filterwarnings("ignore:no labelled document", "ignore:mixing misses")
def test_each_stage_on_awkward_and_empty_rows(spark, sf, name):
    """Nulls, ties, repeats, long texts, and columns of the operators' own names, whose values stay."""
    docs = awkward(spark).selectExpr("*", "-7 as rate", "-8 as rejected", "-9 as n_tokens", "'r' as _rules", "cast(length(text) as long) as n_chars")
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, empty(docs), sf).count() == 0
    found = stored(stage(spark, docs, sf), name)
    if name == "best_fit_packing":
        check_packing(found.collect(), 2048)
        assert {r.doc_id for r in found.collect()} == {r.doc_id for r in docs.collect()}
        return
    assert found.columns == docs.columns
    own = Counter(str(r) for r in docs.collect())
    if name == "secret_scan":
        rest = [c for c in docs.columns if c not in ("text", "n_chars")]
        assert sorted(map(str, found.select(rest).collect())) == sorted(map(str, docs.select(rest).collect()))
        assert Counter(str(r) for r in found.where("text not like '%[secret]%' or text is null").collect()) <= own
        return
    got = Counter(str(r) for r in found.collect())
    assert set(got) <= set(own)
    if name == "language_id":
        assert found.where("text is null or trim(text) = ''").count() == 0 and got <= own
    if name == "simhash_dedup":
        assert max(got.values()) == 1 and found.where("text = 'same text here for all of us'").count() == 1
        assert found.where("doc_id in (0, 1, 6)").count() == 1


def test_run(spark, sf):
    assert corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, sf).count() > 0

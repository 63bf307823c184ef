"""The pipeline's stages against plain versions of what they decide."""

import pytest

import corpus_pipeline
from cutline.llm import langid, pii
from cutline.llm.queries import remainder

from ..compare import DATA
from .test_operators import plain_hits, plain_spans, texts_of


def test_stages(spark):
    folder = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language_id"](spark, docs, folder)
    crf = langid.train(docs, remainder(4) != 2)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in langid.predict(docs, crf).where("lang_pred <> 'und' AND score >= 0.4").collect())
    one = stages["near_dedup"](spark, kept, folder)
    assert one.columns == docs.columns and one.select("text").distinct().count() == one.count() <= kept.select("text").distinct().count()
    clean = stages["decontamination"](spark, one, folder)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    good = sorted(r[0] for r in plain_hits(texts_of(one), items) if not r[-1])
    assert sorted(r.doc_id for r in clean.collect()) == good
    private = stages["pii"](spark, clean, folder)
    before, after = dict(texts_of(clean)), {r.doc_id: r for r in private.collect()}
    assert private.columns == docs.columns and before.keys() == after.keys()
    for i, text in before.items():
        assert (after[i].text == text) or plain_spans(text)
        assert not plain_spans(after[i].text) and after[i].n_chars == len(after[i].text)
    final = stages["bpe"](spark, private, folder)
    assert sorted(r.doc_id for r in final.collect()) == good


def test_run(spark):
    assert corpus_pipeline.run(spark, f"{DATA}/sf0.001").count() > 50
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_nothing_personal_stays(spark, odd):
    for r in pii.sanitise(odd).collect():
        assert not plain_spans(r.text)
    with pytest.raises(AssertionError):
        assert not plain_spans("a@b.co")


def test_stages_on_odd_and_empty_tables(spark, odd):
    """Nulls, empty and very long texts, repeated rows and ids, clashing columns: each stage gives a defined result, and none of them on no rows."""
    folder = f"{DATA}/sf0.001"
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, folder)
        assert kept.columns == odd.columns, name
        before, after = ([(r.doc_id, r.text) for r in df.collect()] for df in (docs, kept))
        if name == "pii":
            assert sorted(map(str, (i for i, _ in before))) == sorted(map(str, (i for i, _ in after)))
        else:
            assert all(after.count(x) <= before.count(x) for x in after)
        if name == "near_dedup":
            assert len({t for _, t in after}) == len(after)
        docs = kept
    ids = corpus_pipeline.STAGES[-1][1](spark, odd, folder).collect()
    assert len(ids) == odd.count() and {r.n_tokens for r in ids if r.doc_id in (0, 1)} == {0}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), folder).count() == 0, name


def test_every_stage_takes_what_the_one_before_kept(spark, monkeypatch):
    folder, seen = f"{DATA}/sf0.001", []
    made = corpus_pipeline.stash

    def noted(df, name):
        held = made(df, name)
        seen.append((name, sorted(r.doc_id for r in held.collect())))
        return held

    monkeypatch.setattr(corpus_pipeline, "stash", noted)
    result = sorted(r.doc_id for r in corpus_pipeline.run(spark, folder).collect())
    assert [n for n, _ in seen] == [n for n, _ in corpus_pipeline.STAGES[:-1]]
    sizes = [spark.read.parquet(f"{folder}/documents.parquet").count(), *(len(ids) for _, ids in seen)]
    assert sizes == sorted(sizes, reverse=True) and sizes[2] < sizes[1] and result == seen[-1][1] == seen[-2][1]
    assert all(set(b) <= set(a) for (_, a), (_, b) in zip(seen, seen[1:], strict=False))

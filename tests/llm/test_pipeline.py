import numpy as np
import pytest
import tiktoken

import corpus_pipeline
from quarry.llm import bpe, mixing, near, quality, toxicity
from quarry.llm.storage import table, written
from test_near import brute

MIDDLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = table(spark, MIDDLE, "documents")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append(written(stage(spark, out[-1], MIDDLE), f"stage-{i}"))
    return out


def ids(df):
    return [r.doc_id for r in df.select("doc_id").collect()]


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "toxicity", "n-gram Jaccard join", "mixing sources to target weights", "byte-level BPE encoding and decoding"]
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns


def test_rejected_documents_go(spark, stages):
    labels = {r.doc_id: r for r in table(spark, MIDDLE, "labels").collect()}
    before, good, clean = (set(ids(df)) for df in stages[:3])
    known = [d for d in before if d in labels]
    assert np.mean([(d in good) == labels[d].quality for d in known]) > 0.95
    assert np.mean([d in clean for d in known if labels[d].quality and not labels[d].toxic]) > 0.97
    scores = stages[0].where(quality.fit_quality(stages[0], table(spark, MIDDLE, "labels")).score(stages[0]["text"]) >= quality.THRESHOLD)
    assert set(ids(scores)) == good
    left = stages[1].where(toxicity.fit_toxicity(stages[1], table(spark, MIDDLE, "labels")).scored(spark, stages[1]["text"])["score"] < toxicity.THRESHOLD)
    assert set(ids(left)) == clean


def test_few_toxic_documents_stay(spark, stages):
    toxic = {r.doc_id for r in table(spark, MIDDLE, "labels").where("toxic = 1").collect()}
    good, clean = (set(ids(df)) for df in stages[1:3])
    assert np.mean([d in clean for d in good & toxic]) <= 0.1


def test_one_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[2].select("doc_id", "text").collect()]
    assert sorted(ids(stages[3])) == sorted({c for c, _ in brute(rows)})
    assert near.jaccard_join(stages[3]).where("n_links > 0").count() == 0


def test_mix_follows_its_budgets(stages):
    taken = {r.doc_id: r.taken for r in mixing.mix_sources(stages[3]).collect()}
    got = dict.fromkeys(taken, 0)
    texts = {r.doc_id: r.text for r in stages[3].collect()}
    for r in stages[4].collect():
        got[r.doc_id] += len(r.text.split())
        assert texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
    assert got == taken


def test_ids_decode_to_the_texts(stages):
    ranks, pattern = bpe.vocabulary()
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = sorted((r.doc_id, r.text) for r in stages[4].collect())
    out = sorted((r.doc_id, known.decode(r.ids)) for r in stages[5].collect())
    assert out == texts
    assert all(r.n_tokens == len(r.ids) for r in stages[5].collect())


def test_run_gives_the_last_stage(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert out.columns == ["doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and out.count() > 0


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, th long"


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "a b c", "en", "s", 5), (2, "a b c", "en", "s", 5), (3, "long " * 30_000, "en", None, 1), (4, "a b c", "de", "s", 5)]])
@pytest.mark.parametrize("labelled", [False, True])
def test_stages_take_odd_rows(spark, tmp_path, rows, labelled):
    """Null, empty, long and repeated rows, empty tables, columns that clash."""
    docs = spark.createDataFrame([(*r, 0.5, "r", 7) for r in rows], COLUMNS)
    labels = [(1, 1, 0), (2, None, None), (2, 1, 1), (3, 1, 0), (None, 1, 1), (9, 0, 0)] if labelled else []
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = written(stage(spark, docs, str(tmp_path)), f"odd-{i}")
        if i < 4:
            assert out.columns == docs.columns
            docs = out
    got = out.collect()
    assert len(got) == docs.count() and all(r.n_tokens == len(r.ids) for r in got)
    if rows:
        # one of each class; a text without a word is not part of a mix; copies are whole or cut at a word
        kept = {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
        assert {i for i, _ in kept} == ({3} if labelled else {2, 3})
        assert all("a b c".startswith(t) if i == 2 else ("long " * 30_000).startswith(t) for i, t in kept)

import pytest
from pyspark.sql import functions as F

from quarry.operators import search
from quarry.operators.index import bm25, build_index
from quarry.operators.vector import cosine, vector


def corpus(spark):
    return spark.createDataFrame([("d1", "x", "a b"), ("d2", "y", "a a c")], "chunk_id string, document_id string, content string")


def scores(df):
    return {(r.query_id, r.chunk_id): r.score for r in df.collect()}


def test_bm25(spark):
    asked = spark.createDataFrame([(1, "b"), (2, "a"), (3, "a a b"), (4, "é")], "query_id long, text string")
    assert scores(bm25(asked, build_index(corpus(spark)))) == {
        (1, "d1"): 0.754913, (2, "d1"): 0.198568, (2, "d2"): 0.237342, (3, "d1"): 0.953481, (3, "d2"): 0.237342,
    }


def test_saved_index(spark, tmp_path):
    from quarry.operators.index import load_index, save_index

    save_index(build_index(corpus(spark)), str(tmp_path))
    asked = spark.createDataFrame([(1, "b")], "query_id long, text string")
    assert scores(bm25(asked, load_index(spark, str(tmp_path)))) == {(1, "d1"): 0.754913}


def test_index_is_built_again_for_a_newer_version(spark, tmp_path):
    from quarry.operators.index import current_index, saved_version

    path, asked = str(tmp_path), spark.createDataFrame([(1, "b")], "query_id long, text string")
    assert saved_version(spark, path) is None
    assert scores(bm25(asked, current_index(corpus(spark), path, 3))) == {(1, "d1"): 0.754913}
    other = spark.createDataFrame([("d9", "x", "b")], "chunk_id string, document_id string, content string")
    assert set(scores(bm25(asked, current_index(other, path, 3)))) == {(1, "d1")} and saved_version(spark, path) == 3
    assert set(scores(bm25(asked, current_index(other, path, 4)))) == {(1, "d9")} and saved_version(spark, path) == 4


def test_batches_of_queries_in_several_passes(spark, monkeypatch):
    from quarry.operators import vector as v

    r = __import__("numpy").random.default_rng(3)
    chunks = spark.createDataFrame([(i, "d", r.normal(size=4).tolist()) for i in range(50)], "chunk_id long, document_id string, embedding array<float>")
    asked = spark.createDataFrame([(i, r.normal(size=4).tolist()) for i in range(40)], "query_id long, embedding array<float>")
    one = sorted(vector(asked, chunks, 3).collect())
    monkeypatch.setattr(v, "BLOCK", 8)
    monkeypatch.setattr(v, "PASS_BYTES", 600)
    assert sorted(vector(asked, chunks, 3).collect()) == one and len(one) == 120
    assert vector(asked.limit(0), chunks, 3).count() == 0


def test_filter_keeps_scores(spark):
    asked = spark.createDataFrame([(1, "a b", "y")], "query_id long, text string, document_id string")
    assert scores(bm25(asked, build_index(corpus(spark)))) == {(1, "d2"): 0.237342}


def test_empty_corpus(spark):
    none = spark.createDataFrame([], "chunk_id string, document_id string, content string")
    index = build_index(none)
    assert index.stats.collect() == [(0, 1.0)]
    assert bm25(spark.createDataFrame([(1, "a")], "query_id long, text string"), index).count() == 0


def ranked(spark, rows):
    return spark.createDataFrame([(1, i, c, s) for i, (c, s) in enumerate(rows, 1)], "query_id long, rnk int, chunk_id string, score double")


def test_rrf(spark):
    a, b = ranked(spark, [("x", 0.9), ("y", 0.8)]), ranked(spark, [("y", 5.0), ("z", 4.0)])
    rows = search.rrf([("vector", a), ("bm25", b)]).orderBy("rnk").collect()
    assert [(r.chunk_id, r.score, r.vector_score, r.bm25_score) for r in rows] == [("y", 0.032522475, 0.8, 5.0), ("x", 0.016393443, 0.9, None), ("z", 0.016129032, None, 4.0)]
    # the order of lists changes nothing but whose score comes first
    again = search.rrf([("bm25", b), ("vector", a)])
    assert {(r.chunk_id, r.rnk, r.score) for r in again.collect()} == {(r.chunk_id, r.rnk, r.score) for r in rows}


def test_rrf_same_list_first_wins(spark):
    a, b = ranked(spark, [("x", 1.0)]), ranked(spark, [("x", 2.0)])
    assert search.rrf([("s", a), ("s", b)]).first().s_score == 1.0


def test_rrf_tells_hits_without_id_apart(spark):
    kinds = "query_id long, rnk int, chunk_id string, document_id string, text string, score double"
    a = spark.createDataFrame([(1, 1, None, "d", "t", 0.9), (1, 2, None, "d", "u", 0.8)], kinds)
    b = spark.createDataFrame([(1, 1, None, "d", "u", 3.0), (1, 2, "c", "e", "v", 2.0)], kinds)
    rows = search.rrf([("vector", a), ("bm25", b)]).orderBy("rnk").collect()
    assert [(r.chunk_id, r.document_id, r.text, r.vector_score, r.bm25_score) for r in rows] == [(None, "d", "u", 0.8, 3.0), (None, "d", "t", 0.9, None), ("c", "e", "v", None, 2.0)]


def test_rerank(spark):
    chunks = spark.createDataFrame([("p", "a b c"), ("q", "a c")], "chunk_id string, content string")
    hits = spark.createDataFrame([(1, 1, "p", 0.0, 0.5, 2.0), (1, 2, "q", 0.0, 0.2, 1.0)], "query_id long, rnk int, chunk_id string, score double, vector_score double, bm25_score double")
    asked = spark.createDataFrame([(1, "a b")], "query_id long, text string")
    assert scores(search.rerank(asked, hits, chunks)) == {(1, "p"): 0.84, (1, "q"): 0.329}


def test_vector(spark):
    chunks = spark.createDataFrame([(1, "x", [1.0, 0.0]), (2, "y", [0.0, 2.0]), (3, "x", [1.0, 1.0]), (4, None, None), (5, "z", [0.0, 0.0])], "chunk_id long, document_id string, embedding array<float>")
    asked = spark.createDataFrame([(7, [2.0, 0.0], None), (8, [0.0, 1.0], "x"), (9, None, None)], "query_id long, embedding array<float>, document_id string")
    got = [(r.query_id, r.chunk_id, r.score) for r in vector(asked, chunks, 2).orderBy("query_id", "rnk").collect()]
    assert got == [(7, 1, 1.0), (7, 3, 0.707107), (8, 3, 0.707107), (8, 1, 0.0)]
    both = chunks.crossJoin(asked.select(F.col("embedding").alias("q"))).select(cosine(F.col("embedding"), F.col("q")).alias("c"))
    assert max(r.c for r in both.collect() if r.c is not None) == pytest.approx(1.0)


def test_search_modes_and_attributes(spark):
    chunks = spark.createDataFrame(
        [("c1", "", "f", "心力衰竭 治疗", "t", 0, "心力衰竭 治疗", [1.0, 0.0]), ("c2", "d", None, "other words", "", 3, "parent", [0.0, 1.0])],
        "chunk_id string, document_id string, file_name string, content string, context string, page_number int, parent_text string, embedding array<float>",
    )
    asked = spark.createDataFrame([(1, "心衰", "hybrid", [1.0, 0.0]), (2, "words", " VECTOR ", [0.0, 1.0]), (3, " ", None, [1.0, 0.0]), (4, "words", None, None)], "query_id long, text string, mode string, embedding array<float>")
    rows = search.search(asked, chunks).orderBy("query_id", "rnk").collect()
    first = {r.query_id: r for r in reversed(rows)}
    assert set(first) == {1, 2, 4}  # the blank one is left out
    assert (first[1].chunk_id, first[1].bm25_score is not None, first[1].document_id, first[1].page_number, first[1].parent_text) == ("c1", True, "(未知)", None, None)
    assert (first[2].chunk_id, first[2].score, first[2].context, first[2].page_number, first[2].parent_text, first[2].file_name) == ("c2", 1.0, None, 3, "parent", "d")
    assert first[4].mode == "rerank" and first[4].chunk_id == "c2"


def shuffled_rows(spark, run):
    """Records that the stages of a run wrote to shuffles."""
    context, double = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm.double

    def total():
        context.listenerBus().waitUntilEmpty(30_000)
        stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    run()
    return total() - before


def test_bm25_makes_no_row_for_a_query_and_a_chunk(spark):
    chunks = spark.range(2000).select(F.col("id").alias("chunk_id"), F.lit("d").alias("document_id"), F.concat(F.lit("the same words and "), F.repeat(F.lit("more "), (F.col("id") % 7).cast("int"))).alias("content"))
    asked = spark.range(50).select(F.col("id").alias("query_id"), F.lit("the words and more").alias("text"))
    moved = shuffled_rows(spark, lambda: bm25(asked, build_index(chunks), 3).collect())
    assert moved < 5000


def test_bm25_in_blocks_and_slices(spark, tmp_path, monkeypatch):
    """Any size of blocks, passes and slices gives the same hits, of a saved index too; ties go to smaller ids."""
    from quarry.operators import index as i

    r = __import__("random").Random(4)
    words = [f"w{x}" for x in range(30)]
    chunks = spark.createDataFrame([(x, f"d{x % 3}" if x % 5 else None, " ".join(r.choice(words) for _ in range(x % 6))) for x in range(120)], "chunk_id int, document_id string, content string").repartition(3).cache()
    asked = spark.createDataFrame([(f"q{x}", " ".join(r.sample(words, 5)), [None, "", "d1"][x % 3]) for x in range(40)], "query_id string, text string, document_id string")
    one = sorted(map(tuple, bm25(asked, build_index(chunks), 7).collect()))
    i.save_index(build_index(chunks, keep=True), str(tmp_path))
    assert sorted(map(tuple, bm25(asked, i.load_index(spark, str(tmp_path)), 7).collect())) == one
    monkeypatch.setattr(i, "BLOCK", 8)
    monkeypatch.setattr(i, "PASS_BYTES", 600)
    monkeypatch.setattr(i, "AT_ONCE", 40)
    assert sorted(map(tuple, bm25(asked, build_index(chunks), 7).collect())) == one and len(one) > 200
    ties = [(a[0], -a[3], a[2]) for a in one]
    assert ties == sorted(ties)
    assert all(chunk % 5 and chunk % 3 == 1 for q, _, chunk, _ in one if int(q[1:]) % 3 == 2)


def test_search_moves_texts_of_candidates_only(spark):
    """Chunks joined with their vectors: other texts than those of hits meet no shuffle."""
    import random

    r = random.Random(6)
    text = lambda: "".join(chr(33 + r.randrange(90)) for _ in range(20_000))
    plain = spark.createDataFrame([(i, "d", ("needle " if i < 2 else "") + text()) for i in range(200)], "chunk_id long, document_id string, content string").repartition(4).localCheckpoint()
    vectors = spark.createDataFrame([(0, [1.0, 0.0])], "chunk_id long, embedding array<float>")
    asked = spark.createDataFrame([(1, "needle", [1.0, 0.0])], "query_id long, text string, embedding array<float>")
    context, double = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm.double
    before, bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), 500_000

    def total():
        context.listenerBus().waitUntilEmpty(30_000)
        stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        start = total()
        assert {x.chunk_id for x in search.search(asked, plain.join(vectors, "chunk_id", "left"), build_index(plain)).collect()} == {0, 1}
        assert total() - start < bound
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

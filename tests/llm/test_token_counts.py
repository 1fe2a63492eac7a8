from pyspark.sql import functions as F

from helpers import duck_rows, spark_rows
from quarry.llm import bpe
from quarry.llm.token_counts import OP1_SQL, TokenRollup, bpe_tokens, contribution, n_tokens, op1_token_counts

C = "struct<source:string,lang:string,tokenizer_version:string,n_tokens:bigint>"


def changes(spark, rows):
    return spark.createDataFrame([(b, a, "x") for b, a in rows], f"before {C}, after {C}, n_docs string")


def totals(rollup):
    return sorted((tuple(r) for r in rollup.totals().collect()), key=str)


def test_signed_batches(spark, tmp_path):
    rollup = TokenRollup(spark, f"file://{tmp_path}/r")
    assert totals(rollup) == []
    assert rollup.commit("1", changes(spark, [(None, ("a", "en", "v1", 5)), (None, ("a", "en", "v1", 7)), (None, (None, None, "v1", 2))]))
    assert rollup.commit("2", changes(spark, [(("a", "en", "v1", 5), ("a", "en", "v2", 6)), (("a", "en", "v1", 7), None), (None, None)]))
    want = [("a", "en", "v2", 1, 6), (None, None, "v1", 1, 2)]
    assert totals(rollup) == sorted(want, key=str)
    # the same batch again, whatever it holds, changes nothing
    assert not rollup.commit("2", changes(spark, [(None, ("b", "en", "v1", 1))]))
    assert totals(TokenRollup(spark, f"file://{tmp_path}/r")) == sorted(want, key=str)
    assert rollup.commit("empty", changes(spark, []))
    assert totals(rollup) == sorted(want, key=str)


def test_compacted_batches(spark, tmp_path):
    rollup = TokenRollup(spark, f"file://{tmp_path}/r")
    assert rollup.compact() and totals(rollup) == []
    rollup.commit("1", changes(spark, [(None, ("a", "en", "v1", 5)), (None, ("b", "en", "v1", 1))]))
    rollup.commit("2", changes(spark, [(("b", "en", "v1", 1), None)]))
    assert rollup.compact() and totals(rollup) == [("a", "en", "v1", 1, 5)]
    # what was summed is still known, what comes later is added
    assert not rollup.commit("1", changes(spark, [(None, ("a", "en", "v1", 5))]))
    assert rollup.commit("3", changes(spark, [(None, ("a", "en", "v1", 2))])) and totals(rollup) == [("a", "en", "v1", 2, 7)]
    assert rollup.compact() and rollup.compact() and totals(TokenRollup(spark, f"file://{tmp_path}/r")) == [("a", "en", "v1", 2, 7)]
    rows, names, _ = rollup._rows()
    assert rows.count() == 1 and len(names) == 3


def test_counts_by_a_vocabulary(spark, tmp_path):
    import public_tokenizers
    import tiktoken

    ranks, pattern = bpe.vocabulary()
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = spark.createDataFrame([("some words, and more", "s"), (None, "s"), ("", "t")], "text string, source string")
    rollup = TokenRollup(spark, f"file://{tmp_path}/r")
    rollup.commit("1", rows.select(F.lit(None).alias("before"), contribution(F.col("source"), F.lit("en"), "bpe-50k", bpe_tokens(spark, F.col("text"))).alias("after")))
    assert totals(rollup) == [("s", "en", "bpe-50k", 2, len(known.encode("some words, and more"))), ("t", "en", "bpe-50k", 1, 0)]


def test_failed_batch_leaves_nothing_and_may_be_sent_again(spark, tmp_path):
    import pytest

    rollup = TokenRollup(spark, f"file://{tmp_path}/r")
    good = changes(spark, [(None, ("a", "en", "v1", 5))])
    broken = good.withColumn("after", F.when(F.raise_error(F.lit("lost")).isNull(), F.col("after")))
    with pytest.raises(Exception, match="lost"):
        rollup.commit("1", broken)
    assert totals(rollup) == []
    assert rollup.commit("1", good) and totals(rollup) == [("a", "en", "v1", 1, 5)]


def test_counts_of_odd_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, " a\tb\u00a0c, d! "), (4, "x " * 50_000)], "i int, text string")
    got = {r.i: (r.a, r.b) for r in rows.select("i", n_tokens(F.col("text"), "words-1").alias("a"), n_tokens(F.col("text"), "wordpunct-2").alias("b")).collect()}
    assert got == {1: (0, 0), 2: (0, 0), 3: (3, 7), 4: (50_000, 50_000)}
    one = rows.select(contribution(F.lit("s"), F.lit(None).cast("string"), "words-1", F.lit(1)).alias("c")).first().c
    assert tuple(one) == ("s", None, "words-1", 1)


def test_whole_table(spark, small):
    assert spark_rows(op1_token_counts(spark, small)) == duck_rows(OP1_SQL, small)

import hashlib
import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import bpe

RANKS, PATTERN = bpe.vocabulary()
REFERENCE = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODER = bpe.ByteBPE(RANKS, PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    ids = CODER.encode(text)
    assert ids == REFERENCE.encode_ordinary(text)
    assert CODER.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 5_000, " " * 5_000, "aaab" * 3_000, "é" * 3_000, "🎉🎊" * 500, "\n \t" * 900])
def test_long_pretokens(text):
    assert CODER.encode(text) == REFERENCE.encode_ordinary(text)


def test_random_long_pretokens():
    r = random.Random(4)
    for letters in ("ab", "abcdefghijklmnop", "thern"):
        text = "".join(r.choice(letters) for _ in range(4_000))
        assert CODER.encode(text) == REFERENCE.encode_ordinary(text)


def test_ranks_that_are_not_of_merges():
    """A lower rank may appear only after a merge of a higher one."""
    ranks = {bytes([i]): i + 10 for i in range(256)} | {b"bc": 300, b"abc": 1, b"ab": 400, b"cd": 350, b"abcd": 2, b"aa": 500, b"aaa": 3}
    own = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    coder = bpe.ByteBPE(ranks, r"[\s\S]+")
    r = random.Random(9)
    for _ in range(300):
        text = "".join(r.choice("abcd") for _ in range(r.randint(1, 40)))
        assert coder.encode(text) == own.encode_ordinary(text)


def test_queue_order():
    q, r = bpe.RankQueue(), random.Random(1)
    items = [(r.randint(0, 1000), r.randint(0, 50)) for _ in range(500)]
    for rank, place in items:
        q.push(rank, place)
    out = []
    while q.high:
        out.append(q.pop())
    assert out == sorted(items)


def test_remembered_is_bounded():
    coder = bpe.ByteBPE(RANKS, PATTERN, 10)
    text = " ".join(f"w{i}q" for i in range(200))
    assert coder.encode(text) == REFERENCE.encode_ordinary(text) and len(coder.known) <= 10 and len(coder.known.older) <= 10


def test_columns(spark):
    texts = [None, "", "hello world", "hello world", "x" * 100_000, "naïve 高血压"]
    rows = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "doc_id int, text string, ids array<int>")
    got = rows.select("doc_id", bpe.encoded(spark, F.col("text"), RANKS, PATTERN).alias("e")).select("doc_id", "e", bpe.decoded(spark, F.col("e"), RANKS).alias("d")).collect()
    for r in got:
        assert r.e == REFERENCE.encode_ordinary(texts[r.doc_id] or "") and bytes(r.d) == (texts[r.doc_id] or "").encode()


def test_whole_table(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    out = bpe.op8_byte_bpe(spark, small).collect()
    assert len(out) == len(docs)
    for r in out:
        ids = REFERENCE.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())


def test_chunks_by_a_vocabulary(spark):
    """Budgets count the vocabulary's tokens; strings of tokens give the text back."""
    from quarry.operators.chunking import ChunkOptions, chunk

    counter = bpe.BpeTokens(spark)
    texts = ["高血压急症 héllo wörld 👩‍⚕️ " * 3, "plain words here", "", "x" * 50]
    df = spark.createDataFrame([(texts,), (None,), ([],)], "t array<string>")
    coder = bpe.ByteBPE(counter.ranks, counter.pattern)
    got = [r[0] for r in df.select(counter.tokens(F.col("t"))).collect()]
    assert ["".join(x) for x in got[0]] == texts and [len(x) for x in got[0]] == [len(coder.encode(t)) for t in texts]
    assert got[1] is None and got[2] == []
    lines = [f"line {i} of 高血压 text with some words" for i in range(60)] + ["long " * 90]
    elements = spark.createDataFrame([("d", 0, None, i, "para", x) for i, x in enumerate(lines)], "document_id string, section_no int, page_number int, element_no int, kind string, text string")
    options = ChunkOptions(parent_tokens=200, child_tokens=60, overlap_tokens=10, counter=counter)
    out = chunk(elements, options, cleaned=True).orderBy("parent_no", "child_no").collect()
    n = lambda text: sum(len(coder.encode(x)) for x in text.split("\n"))
    assert all(n(c.content) <= 60 + 20 for c in out) and len(out) > 10
    assert {x for c in out for x in c.content.split("\n")} >= set(lines[:-1])

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import chunking
from quarry.operators.chunking import ChunkOptions

SMALL = ChunkOptions(parent_tokens=20, child_tokens=8, overlap_tokens=3)


def count(text):
    import re

    return max(1, len(re.findall(r"\s*(?:[A-Za-z0-9_]+|\S)", text)))


def windows(text, size, step):
    words = text.split(" ")
    out = []
    for i in range(0, len(words), step):
        out.append(" ".join(words[i : i + size]))
        if i + size >= len(words):
            break
    return out


def model_children(parent, o):
    """Children of a parent whose lines are words joined by single spaces."""
    out, held = [], []
    for line in [x.strip() for x in parent.split("\n") if x.strip()]:
        if count(line) > o.child_tokens:
            if held:
                out.append("\n".join(held))
            held = []
            out += windows(line, o.child_tokens, o.child_tokens - o.overlap_tokens)
        else:
            if held and sum(map(count, held)) + count(line) > o.child_tokens:
                out.append("\n".join(held))
                keep = len(held)
                while keep and sum(map(count, held[keep:])) < o.overlap_tokens:
                    keep -= 1
                held = held[keep:]
            held.append(line)
    return out + (["\n".join(held)] if held else [])


def model_parents(elements, o):
    out, held, heading = [], [], ""
    for kind, text in elements:
        if kind == "header":
            if held:
                out.append((heading, "\n".join(held)))
            heading, held = text, [text] if text.strip() else []
        elif text.strip():
            if held and sum(map(count, held)) + count(text) > o.parent_tokens:
                out.append((heading, "\n".join(held)))
                held = []
            held.append(text)
    return out + ([(heading, "\n".join(held))] if held else [])


def lines(r, n):
    return [" ".join(r.choice("ab cd efg h_1".split()) for _ in range(r.randint(1, 14))) for _ in range(n)]


def test_children_match_model(spark):
    r = random.Random(5)
    parents = ["\n".join(lines(r, r.randint(0, 12))) for _ in range(60)] + ["", "\n\n", " a \n\n b "]
    df = spark.createDataFrame(list(enumerate(parents)), "i int, p string").select("i", chunking.split_children(F.col("p"), SMALL).alias("c"))
    assert {x.i: x.c for x in df.collect()} == {i: model_children(p, SMALL) for i, p in enumerate(parents)}


def test_parents_match_model(spark):
    r = random.Random(6)
    cases = [[("header" if r.random() < 0.2 else "para", r.choice([*lines(r, 3), " "])) for _ in range(r.randint(0, 15))] for _ in range(60)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, e array<struct<kind:string,text:string>>").select("i", chunking.split_parents(F.col("e"), SMALL).alias("p"))
    assert {x.i: [(p.heading, p.text) for p in x.p] for x in df.collect()} == {i: model_parents(c, SMALL) for i, c in enumerate(cases)}


def test_split_long(spark):
    text = " ".join(f"w{i}" for i in range(17))
    got = spark.range(1).select(chunking.split_long(F.lit(text), 8, 5)).first()[0]
    assert got == windows(text, 8, 5)
    assert spark.range(1).select(chunking.split_tokens(F.lit(text), 8)).first()[0] == windows(text, 8, 8)
    assert spark.range(1).select(chunking.split_long(F.lit(""), 8, 5)).first()[0] == []


def test_title(spark):
    title = lambda h, p: spark.range(1).select(chunking.title_of(F.lit(h), F.lit(p))).first()[0]
    assert title(" ", "first\nsecond") == "first"
    assert title("h" * 90, "x") == "h" * 80


def test_chunks(spark):
    rows = [("d", 0, 2, 0, "header", 1, "高血压"), ("d", 0, 2, 1, "para", None, "text one"), ("d", 1, 0, 0, "para", None, "12"), ("d", 1, 0, 1, "para", None, "tail")]
    elements = spark.createDataFrame(rows, "document_id string, section_no int, page_number int, element_no int, kind string, level int, text string")
    got = chunking.chunk(elements).orderBy("section_no").collect()
    assert [(c.content, c.context, c.page_number, c.entities) for c in got] == [("高血压\ntext one", "高血压", 2, ["高血压"]), ("tail", "tail", None, [])]
    assert [c.chunk_id for c in got] == [c.chunk_id for c in chunking.chunk(elements).orderBy("section_no").collect()]
    assert chunking.chunk(elements.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["child_chunks", "parent_chunks"])
def test_documents_are_covered(spark, small, name):
    from quarry.plans.queries import QUERIES

    got = QUERIES[name](spark, small)
    assert got.select("document_id").distinct().count() == spark.read.parquet(f"{small}/documents.parquet").where("trim(text) <> ''").count()
    if name == "child_chunks":
        docs = {str(r.doc_id): r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
        whole = {k: " ".join(v.split()) for k, v in docs.items()}
        for c in got.collect():
            assert " ".join(c.content.split()) in whole[c.document_id] or count(c.content) <= 280

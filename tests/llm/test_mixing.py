import random
from collections import defaultdict

from pyspark.sql import functions as F

from quarry.llm import mixing
from quarry.llm.mixing import mix_sources, mixed_documents, op4_mix_sources, source_targets

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, taken string, key double, row int"


def shares(sizes, weights, cap):
    """Shares by repeated resharing of what is above a limit."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        if not free:
            return fixed
        left = total - sum(fixed.values())
        wanted = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if wanted[s] > cap * sizes[s] + 1e-9]
        if not over:
            return fixed | wanted
        fixed |= {s: cap * sizes[s] for s in over}


def test_targets_match_resharing(spark):
    r = random.Random(3)
    for _ in range(6):
        sizes = {f"s{i}": r.choice([0, 1, 5, 40, 1000]) for i in range(r.randint(1, 9))} | ({None: 7} if r.random() < 0.5 else {})
        rows = source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), [1, 2, 3], 3).collect()
        want = shares(sizes, [1, 2, 3], 3)
        for row in rows:
            assert abs(row.target - want[row.source]) < 1e-6, (sizes, rows)


def test_places_in_order(spark):
    names = [f"é{i * 7919 % 500}" for i in range(500)] + [None]
    rows = mixing.numbered(spark.createDataFrame([(x,) for x in names], "source string").repartition(7), "source").collect()
    want = sorted(x for x in names if x) + [None]
    assert [r.source for r in sorted(rows, key=lambda r: r.n)] == want and sorted(r.n for r in rows) == list(range(501))


def test_a_source_for_each_host(spark):
    """Thousands of sources, one with half of the words."""
    sizes = {f"h{i}": 1 + i % 7 for i in range(3000)} | {"big": 9000}
    rows = source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), [1, 2, 3], 3).collect()
    want = shares(sizes, [1, 2, 3], 3)
    assert all(abs(r.target - want[r.source]) < 1e-6 for r in rows) and len(rows) == 3001


def test_texts_of_one_id_and_length_are_cut_alike(spark):
    rows = [(1, t, "en", "a") for t in ("x y z", "p q r", "l m n")] + [(2, "w " * 100, "en", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    once = sorted(map(tuple, mixed_documents(docs, weights=[1.0, 80.0]).collect()))
    assert once == sorted(map(tuple, mixed_documents(docs.orderBy("text", ascending=False).repartition(3), weights=[1.0, 80.0]).collect()))


def test_other_column_names_of_the_mix(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", "t"), (2, "d e", "s", "t")], "key long, body string, origin string, text string")
    got = mixed_documents(docs, id_col="key", text_col="body", source_col="origin")
    assert got.columns == docs.columns and sorted((r.key, r.body) for r in got.collect()) == [(1, "a b c"), (2, "d e")]


def brute(rows, targets, cap=3):
    """rows: (doc_id, source, size, key) -> sorted (doc_id, taken)."""
    by = defaultdict(list)
    for row in rows:
        by[row[1]].append(row)
    out = []
    for source, own in by.items():
        own.sort(key=lambda x: (x[3], x[0] is not None, x[0], x[2]))
        left, got = int(targets[source]), [0] * len(own)
        for _ in range(cap):
            for i, x in enumerate(own):
                take = min(x[2], left)
                got[i] += take
                left -= take
        out += [(x[0], g) for x, g in zip(own, got, strict=True)]
    return sorted(out, key=str)


def keyed(docs, seed=7):
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source"), F.coalesce(F.length("text"), F.lit(-1)))
    rows = docs.select("doc_id", "source", mixing.word_count(F.col("text")), key).collect()
    return [(r[0], r[1], r[2], r[3] % 2**64 // 2) for r in rows]


def test_whole_table_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = op4_mix_sources(spark, small).collect()
    targets = dict((r.source, r.target) for r in mix_sources(docs).select("source", "target").distinct().collect())
    assert sorted(((r.doc_id, r.taken) for r in got), key=str) == brute(keyed(docs), targets)
    assert sum(r.taken for r in got) <= sum(targets.values()) + 1e-6
    assert all(r.taken <= 3 * r.size for r in got)


def test_ranges_do_not_change_the_mix(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    once = sorted(map(tuple, mix_sources(docs).select("doc_id", "taken").collect()))
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", 2)
    assert sorted(map(tuple, mix_sources(docs).select("doc_id", "taken").collect())) == once


def odd(spark):
    long = " ".join(["w"] * 30_000)
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "one\ttwo  three ", "en", "a"), (4, long, None, "b"), (None, "x y", "en", None), (5, "p q", "en", None), (5, "p q", "en", None), (5, "p q", "en", None)]
    return spark.createDataFrame([(*r, None, 9, "t", 0.5, 1) for r in rows], DOCS)


def test_odd_rows(spark):
    got = {(r.doc_id, r.source): r for r in mix_sources(odd(spark)).collect()}
    assert (got[1, "a"].size, got[1, "a"].taken, got[2, "a"].taken) == (0, 0, 0)
    assert got[3, "a"].size == 3 and got[3, "a"].taken == 9  # three epochs are its limit
    assert got[4, "b"].size == 30_000
    assert mix_sources(odd(spark).limit(0)).count() == 0
    assert all(r.taken == 0 for r in mix_sources(odd(spark).where("doc_id < 3")).collect())
    same = mix_sources(odd(spark).where("source is null")).collect()
    assert len(same) == 4 and sum(r.taken for r in same) == 8


def test_documents_of_the_mix(spark):
    docs = odd(spark)
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.schema == docs.schema
    want = defaultdict(int)
    for r in mix_sources(docs).collect():
        want[r.source] += r.taken
    got = defaultdict(int)
    for r in mixed.collect():
        got[r.source] += len(r.text.split())
    assert {k: v for k, v in want.items() if v} == dict(got)
    assert [r.text for r in mixed.where("doc_id = 3").collect()] == ["one\ttwo  three "] * 3

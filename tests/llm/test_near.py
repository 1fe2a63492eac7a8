import random
from collections import Counter

import numpy as np
import pytest

from quarry.llm import near
from quarry.llm.components import components
from quarry.llm.near import MinHash, bands_for, deduplicated, jaccard_join, ngram_set, op9_ngram_join


def brute(rows, threshold=0.8):
    """rows: (doc_id, text) -> {row number: (class_id, n_links)} by all pairs."""
    sets = []
    for _, text in rows:
        import re

        words = re.findall(r"\w+", (text or "").lower())
        n = min(5, len(words))
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else ({text} if text else set()))
    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    up, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, s in enumerate(sets):
        common = Counter(j for g in s for j in holders[g])
        for j, c in common.items():
            if j != i and c >= threshold * (len(s) + len(sets[j]) - c) - 1e-9:
                links[i] += 1
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(least.get(root(i)) if sets[i] else rows[i][0], links[i]) for i in range(len(rows))]


def check(spark, rows):
    df = spark.createDataFrame([(d, t, 1, "s") for d, t in rows], "doc_id long, text string, th int, sid string")
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard_join(df).collect()), key=str)
    assert got == sorted(((d, *b) for (d, _), b in zip(rows, brute(rows), strict=True)), key=str)


def words(r, n):
    return [f"w{r.randint(0, 5000)}" for _ in range(n)]


def family(r, size, length, changes):
    base = words(r, length)
    out = []
    for _ in range(size):
        own = list(base)
        for _ in range(r.randint(0, changes)):
            own[r.randrange(length)] = f"x{r.randint(0, 10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("tile", [128, 7])
def test_families(spark, monkeypatch, tile):
    monkeypatch.setattr(near, "TILE", tile)
    r = random.Random(11)
    texts = family(r, 60, 200, 4) + family(r, 20, 60, 2) + family(r, 5, 400, 12) + [" ".join(words(r, 50)) for _ in range(60)]
    texts += texts[:10] + texts[80:84]
    r.shuffle(texts)
    check(spark, [(i * 3 - 50, t) for i, t in enumerate(texts)])


def test_odd_rows(spark):
    long = " ".join(f"v{i}" for i in range(30_000))
    rows = [
        (1, None), (2, ""), (3, None), (4, "   "), (5, "   "), (6, "%%%"), (7, "a b"), (8, "A, b!"), (9, "a b c"), (10, long), (11, long + " tail"), (12, long), (None, "n u l l s here"), (None, "n u l l s here"),
        (13, "n u l l s here"), (None, "alone text of no id at all"), (14, "same same same same same same same"), (14, "same same same same same same same"), (14, "another text under the id"), (15, "same " * 400),
        (None, "p q r s t u v w x y z " * 2), (16, "P Q R S T U V W X Y Z " * 2), (17, "p q r s t u v w x y z " * 2 + "tail"),
    ]
    check(spark, rows)


def test_empty_table(spark):
    assert jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    check(spark, [(1, "only one")])


def test_thresholds_at_the_border(spark):
    base = [f"q{i}" for i in range(40)]  # 36 n-grams
    rows = [(1, " ".join(base)), (2, " ".join(base + [f"r{i}" for i in range(9)])), (3, " ".join(base + [f"s{i}" for i in range(10)]))]
    assert [b[1] for b in brute(rows)] == [1, 1, 0]  # 36 / 45 is in, 36 / 46 is out
    check(spark, rows)


def test_recall_of_bands():
    assert bands_for(0.8, 0.9999, 5) == 24
    for rows in (3, 5, 8):
        b = bands_for(0.8, 0.99, rows)
        assert 1 - (1 - 0.8**rows) ** b >= 0.99 > 1 - (1 - 0.8**rows) ** (b - 1)
    r, hasher, met = np.random.default_rng(5), MinHash(24, 5), 0
    for _ in range(200):
        both, a, b = (np.unique(r.integers(0, 2**63, n, dtype=np.uint64)) for n in (200, 25, 25))
        x, y = hasher.band_hashes(np.union1d(both, a)), hasher.band_hashes(np.union1d(both, b))
        met += bool((x == y).any())
    assert met == 200


def test_ngrams():
    assert len(ngram_set("a b c d e f")) == 2 and len(ngram_set("a b")) == 1 and len(ngram_set("")) == 0 and len(ngram_set("?")) == 1
    assert ngram_set("A b, c d E")[0] == ngram_set("a b c d e")[0] != ngram_set("b a c d e")[0]
    assert ngram_set("a b c d")[0] != ngram_set("a b c d d")[0]


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(330)] + [(i, i + 1) for i in range(1000, 1200)] + [(5, 5), (None, 3), (2000, 2001), (2001, 2000)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    got = {(x.node, x.component) for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(x, root(x)) for x in up}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_a_node_with_half_of_the_edges(spark):
    edges = [(0, i) for i in range(1, 600)] + [(i, i + 1) for i in range(1000, 1600)]
    got = {(x.node, x.component) for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(i, 0) for i in range(600)} | {(i, 1000) for i in range(1000, 1601)}


def test_rows_repeated_very_often(spark):
    """Half of the rows are one row; its text meets the others once."""
    base = [f"q{i}" for i in range(40)]
    rows = [(1, " ".join(base))] * 300 + [(i, " ".join([*base[:38], f"x{i}", f"y{i}"])) for i in range(2, 40)] + [(i, f"other text number {i} of words {i * 7} alone") for i in range(100, 300)]
    check(spark, rows)
    assert deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id < 100").count() == 1


def test_other_column_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", 5), (2, "a b c d e f g", 6), (3, "alone here with no other text", 7)], "key long, body string, doc_id int")
    assert sorted(r.key for r in deduplicated(docs, id_col="key", text_col="body").collect()) == [1, 3]


def test_one_of_each_class_stays(spark):
    rows = [(3, "a b c d e f g", "x"), (1, "a b c d e f g", "y"), (1, "a b c d e f g", "z"), (2, "other words entirely in this one", "x"), (4, None, "x"), (None, "z z z", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    kept = deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=str) == sorted([(1, "a b c d e f g"), (2, "other words entirely in this one"), (4, None), (None, "z z z")], key=str)


def test_whole_table(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = {r.doc_id: (r.class_id, r.n_links) for r in op9_ngram_join(spark, small).collect()}
    assert got == {d: b for (d, _), b in zip(docs, brute(docs), strict=True)}


def test_one_row_of_each_class_stays_without_or_with_repeated_ids(spark):
    base = [f"q{i}" for i in range(40)]
    near, far = " ".join(base), " ".join(base + ["r1", "r2"])
    for ids in ((None, None), (7, 7)):
        docs = spark.createDataFrame([(ids[0], near), (ids[1], far)], "doc_id long, text string")
        assert deduplicated(docs).count() == 1
    nothing = [(None, None), (None, None), (None, ""), (None, ""), (3, ""), (3, "")]
    assert sorted([tuple(r) for r in deduplicated(spark.createDataFrame(nothing, "doc_id long, text string")).collect()], key=str) == sorted(nothing, key=str)

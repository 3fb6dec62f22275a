"""Components against all pairs of documents."""

import random
import re

import pytest

from rivermeld.llm import near_duplicates as nd
from rivermeld.llm.shared import table

SF_DIR = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows, percent=85):
    """{(doc_id, text): (n, component)} by testing every pair of different sets."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                common = len(a & b)
                if 100 * common >= percent * (len(a) + len(b) - common):
                    parent[root(i)] = root(j)
    out = {}
    for i, (doc_id, text) in enumerate(rows):
        known = [r[0] for j, r in enumerate(rows) if root(j) == root(i) and r[0] is not None]
        out[(doc_id, text)] = (len(sets[i]), min(known) if known else None)
    return out


def compare(spark, frame, rows):
    want = brute(rows)
    got = nd.near_duplicates(frame).join(frame.select("doc_id", "text").distinct().withColumnRenamed("doc_id", "id"),
                                         (nd.F.xxhash64(nd.F.lit(1), "id", "text") == nd.F.col("f1"))).collect()
    assert len(got) == len(rows)
    for r in got:
        n, component = want[(r["doc_id"], r["text"])]
        assert (r["n_shingles"], r["component_id"]) == (n, component), r
        assert r["kept"] == (r["doc_id"] == component)


def changed(words, share, rng):
    return [rng.choice("abcdefgh") + str(rng.randrange(999)) if rng.random() < share else w for w in words]


def test_all_documents(spark):
    frame = table(spark, SF_DIR, "documents").select("doc_id", "text")
    compare(spark, frame, [tuple(r) for r in frame.collect()])


def test_groups_of_copies_near_the_threshold(spark, docs):
    rng = random.Random(3)
    rows = []
    for group in range(6):
        base = [f"w{rng.randrange(2000)}" for _ in range(150)]
        for _ in range(40):
            rows.append((rng.randrange(10**6), " ".join(changed(base, rng.choice([0, 0.01, 0.02, 0.04]), rng))))
    chain = [f"c{k}" for k in range(400)]
    rows += [(2_000_000 + k, " ".join(chain[10 * k:10 * k + 200])) for k in range(15)]
    rows = list({r[0]: r for r in rows}.values())
    compare(spark, docs(rows), rows)


def passage_rows():
    """160 texts of 40 small groups that all hold one passage of two thirds of their words: one bucket, many components."""
    rng = random.Random(11)
    passage = [f"p{k}" for k in range(200)]
    rows = []
    for group in range(40):
        own = [f"g{group}w{k}" for k in range(100)]
        for _ in range(4):
            rows.append((rng.randrange(10**6), " ".join(passage + changed(own, rng.choice([0.01, 0.02, 0.05]), rng))))
    return list({r[0]: r for r in rows}.values())


@pytest.mark.parametrize("block", [nd.BLOCK, 7])
def test_one_bucket_of_many_small_groups(spark, docs, monkeypatch, block):
    monkeypatch.setattr(nd, "BLOCK", block)
    rows = passage_rows()
    assert len({component for _, component in brute(rows).values()}) > 20
    compare(spark, docs(rows), rows)


def test_frequent_half_keys_are_cut_into_blocks(spark, monkeypatch):
    """Every pair of a bucket meets in exactly one block, and no block holds much more than its share."""
    monkeypatch.setattr(nd, "BLOCK", 50)
    first = spark.range(1000).selectExpr("id AS node", "id DIV 2 AS root", "7L AS half").unionByName(
        spark.range(3).selectExpr("id AS node", "0L AS root", "8L AS half"))
    mixed = nd._mixed_buckets(first)
    assert {(r.half, r.slices) for r in mixed.collect()} == {(7, 20)}
    assert mixed.where("NOT outside").count() == 2
    mine = mixed.withColumns({"i": nd._slice(), "j": nd.F.explode(nd._slices())})
    others = mixed.select(nd.F.col("node").alias("o_node"), "half", "slices").withColumn("j", nd.F.pmod(nd.F.xxhash64("half", "o_node"), "slices").cast("int"))
    others = others.withColumn("i", nd.F.explode(nd._slices())).drop("slices")
    assert max(r["count"] for r in mine.groupBy("i", "j").count().collect()) < 100
    met = mine.join(others, ["half", "i", "j"]).groupBy("node", "o_node").count()
    assert (met.count(), met.agg({"count": "max"}).first()[0]) == (1_000_000, 1)


def test_odd_rows(spark, docs):
    assert nd.near_duplicates(docs([]).select("doc_id", "text")).count() == 0
    rows = [(5, None), (6, ""), (7, " \t"), (8, "One two"), (3, "one TWO"), (9, "one"), (None, "one"), (None, "alone here"),
            (4, "É a b c d e f"), (2, "é a b c d e f"), (1, "one two"), (1, "one two")]
    compare(spark, docs(rows), rows)


def test_clean_keeps_one_of_each_group_and_all_columns(spark, docs):
    rows = [(2, "a b c d e f"), (1, "A b c d e f"), (3, "other words stand in this one"), (1, "A b c d e f"), (4, None)]
    out = nd.clean(docs(rows))
    assert out.columns == docs(rows).columns
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 3, 4]


@pytest.mark.parametrize("percent", [85])
def test_missing_a_link_is_unlikely(percent):
    b = nd.Banding()
    half = (percent / 100) ** b.width
    assert 1 - (1 - (1 - half) ** b.halves) ** 2 < 1e-5


def test_clean_keeps_one_of_near_copies_with_null_or_tied_identifiers(spark):
    base = " ".join(f"word{k}" for k in range(300))
    other = " ".join(f"term{k}" for k in range(300))
    rows = [(None, base + " a"), (None, base + " b"), (7, other + " a"), (7, other + " b"), (None, ""), (3, None), (9, "own words of nobody else at all here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, (r.text or "")[:5]) for r in nd.clean(docs).collect()]
    assert sorted(kept, key=str) == sorted([(None, "word0"), (7, "term0"), (None, ""), (3, ""), (9, "own w")], key=str)
    mixed = spark.createDataFrame([(None, base + " a"), (5, base + " b"), (5, base + " c"), (6, base)], "doc_id long, text string")
    assert [r.doc_id for r in nd.clean(mixed).collect()] == [5]

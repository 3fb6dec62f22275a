"""Merkle manifest against plain Python over trees of several heights, and what tampering does to a proof."""

import hashlib

import pytest
from pyspark.sql import functions as F

from rivermeld.llm.merkle_manifest import folded, manifest, proof

KIND = "doc_id long, source string, lang string, n_chars long, text string, g string, pos long, h string, `way` string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(hashes, fanout):
    """(root, path of siblings of every leaf) of one list of nodes."""
    paths, at, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        for leaf, k in enumerate(at):
            run = k - k % fanout
            paths[leaf].append(("".join(level[run:k]), "".join(level[k + 1:run + fanout])))
        level = [sha(*level[k:k + fanout]) for k in range(0, len(level), fanout)]
        at = [k // fanout for k in at]
    return level[0], paths


def expected(rows, fanout):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0], sha(*[framed(v) for v in r[:5]])))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = climb([h for _, h in groups[g]], fanout)
    root, over = climb([trees[g][0] for g in names], fanout)
    return sorted((str(i), h, trees[g][0], root, tuple(path + over[k]))
                  for k, g in enumerate(names) for (i, h), path in zip(groups[g], trees[g][1]))


def rows_of(n, sources):
    return [(k * 7 % n if k % 50 else None, sources(k), "en" if k % 3 else None, k, f"text é {k}" if k % 11 else None, "a", 1, "b", "c")
            for k in range(n)]


@pytest.mark.parametrize("fanout,n,sources", [
    (2, 90, lambda k: f"s{k % 5}" if k % 7 else None), (3, 700, lambda k: "hot" if k % 3 else f"s{k % 40}"), (16, 900, lambda k: "only"),
    (16, 400, lambda k: f"{k}" if k < 300 else ""), (4, 1, lambda k: "one"), (16, 257, lambda k: "z")])
def test_equals_plain_python(spark, fanout, n, sources):
    rows = rows_of(n, sources)
    rows += rows[3:9]  # rows that repeat are leaves of their own
    found = manifest(spark.createDataFrame(rows, KIND).repartition(5), fanout=fanout).rows
    got = sorted((str(r.doc_id), r.leaf, r.subroot, r.root, tuple((s.before, s.after) for s in r.path)) for r in found.collect())
    assert got == expected(rows, fanout)


def test_folding_finds_tampering(spark):
    rows = rows_of(120, lambda k: f"s{k % 4}")
    found = manifest(spark.createDataFrame(rows, KIND), carried={"length": F.length("text")}).rows
    assert found.columns == ["doc_id", "length", "leaf", "subroot", "root", "path"]
    out = found.select(folded(F.col("leaf"), F.col("path")).alias("same"), folded(F.sha2(F.lit("x"), 256), F.col("path")).alias("other"),
                       "root", proof(F.col("path")).alias("proof"), "path").collect()
    assert all(r.same == r.root and r.other != r.root for r in out)
    assert all(r.proof == sha(*[s.before + s.after for s in r.path]) for r in out)


def test_empty_and_very_long(spark):
    assert manifest(spark.createDataFrame([], KIND)).rows.count() == 0
    text = "é" * 3_000_000
    row = manifest(spark.createDataFrame([(1, None, None, None, text, "", 0, "", "")], KIND)).rows.first()
    assert row.leaf == row.root == row.subroot == sha(framed(1), "---", framed(text)) and row.path == []


def test_levels_are_returned(spark):
    made = manifest(spark.createDataFrame(rows_of(600, lambda k: f"s{k % 2}"), KIND))
    assert [level.count() for level in made.levels] == [600, 38, 4, 2]
    assert {(r.n_leaves, r.height) for r in made.groups.collect()} == {(300, 3)}

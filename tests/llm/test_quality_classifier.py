"""Held-out accuracy of the classifier, shrinkage of sites, and odd rows."""

import math

import pytest
from pyspark.sql import functions as F

from rivermeld.llm import quality_classifier as qc
from rivermeld.llm.shared import table

SF_DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "labels")
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2))
    rows = qc.classified(docs, labels.where(half == 0)).join(labels.where(half == 1), "doc_id").collect()
    quality = sum((r["p_document"] / max(1e-9, 1 - r["p_toxic"]) >= 0.5) == (r["quality"] == 1) for r in rows) / len(rows)
    clean = [r for r in rows if r["quality"] == 1 and r["toxic"] == 0]
    bad = [r for r in rows if r["quality"] == 0]
    assert quality > 0.93
    assert sum(r["kept"] for r in clean) / len(clean) > 0.95
    assert sum(not r["kept"] for r in bad) / len(bad) > 0.8


def test_posteriors_against_plain_python(spark):
    rows = [("a", "x", 0.9)] * 40 + [("a", "y", 0.2)] * 10 + [("b", "x", 0.5)] * 30 + [("c", None, 0.1), (None, "x", 0.99)]
    got, share = qc.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double"))
    posterior = {(r["host"], r["path"]): r["p_site"] for r in got.collect()}
    assert share == pytest.approx(sum(r[2] for r in rows) / len(rows))
    groups = {}
    for h, q, p in rows:
        groups.setdefault(h, []).append(p)

    def strength(parts):
        parts = [(n, m, min(1 - 1e-6, max(1e-6, t))) for n, m, t in parts if n > 1]
        total = sum(n for n, _, _ in parts)
        between = (sum(n * (m - t) ** 2 for n, m, t in parts) - sum(t * (1 - t) for _, _, t in parts)) / total
        within = sum(n * t * (1 - t) for n, _, t in parts) / total
        return min(1e6, max(1.0, within / between - 1)) if between > 0 else 1e6

    k = strength([(len(v), sum(v) / len(v), share) for v in groups.values()])
    host = {h: (sum(v) + k * share) / (len(v) + k) for h, v in groups.items()}
    paths = {}
    for h, q, p in rows:
        paths.setdefault((h, q), []).append(p)
    k = strength([(len(v), sum(v) / len(v), host[h]) for (h, _), v in paths.items()])
    assert posterior == pytest.approx({(h, q): (sum(v) + k * host[h]) / (len(v) + k) for (h, q), v in paths.items()})
    assert abs(posterior[("c", None)] - host["c"]) < abs(0.1 - host["c"]) + 1e-12


def test_odd_rows(spark, docs):
    labels = "doc_id long, quality int, toxic int"
    empty = spark.createDataFrame([], labels)
    assert qc.classified(docs([]), empty).count() == 0
    rows = [(1, None, None), (2, ""), (None, "some words here."), (2, ""), (3, "word " * 30000)]
    out = qc.classified(docs(rows), empty).collect()
    assert len(out) == 5 and all(math.isfinite(r["p_good"]) for r in out)
    one_class = spark.createDataFrame([(1, 1, None), (2, 1, 0), (None, 0, 0), (3, None, 1)], labels)
    assert all(r["kept"] for r in qc.classified(docs(rows), one_class).collect())


def test_regression_finds_the_maximum():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3)) * [1, 10, 0.1]
    y = (x @ [1.0, 0.1, 5.0] + rng.normal(size=400) > 0.3).astype(float)
    model = qc.fit(x, y, 1.0)
    z = (x - x.mean(0)) / x.std(0)
    p = 1 / (1 + np.exp(-(x @ model.weights + model.intercept)))
    assert np.allclose(z.T @ (p - y) + np.array(model.weights) * x.std(0), 0, atol=1e-5)


def test_whole_result_against_plain_python(spark):
    """p_site and p_good of every document from the evidence of all others of its host and path, urls as paths included."""
    import random

    rng = random.Random(4)
    texts = ["plain words of a fine text, as they come. " * 6, "BUY NOW!!! $$$ click here " * 9, "short", None]
    rows = [(k % 70, rng.choice(texts), f"h{k % 3}", rng.choice(["/a/b?x=1", "/c", None])) for k in range(90)] + [(500, texts[0], "alone", "/only")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0), int(k % 11 == 0)) for k in range(70)], "doc_id long, quality int, toxic int")
    got = qc.classified(docs, labels).collect()
    assert len(got) == len(rows)
    scored = docs.join(spark.createDataFrame([(r.doc_id, r.p_document) for r in got], "doc_id long, p double").groupBy("doc_id").agg(F.collect_list("p").alias("ps")), "doc_id")
    ps = {}
    for r in got:
        ps.setdefault(r.doc_id, []).append(r)
    single = [r for r in scored.collect() if len(r.ps) == 1]
    sums, share = qc.site_posteriors(spark.createDataFrame(
        [(s, q, p) for (s, q, p) in evidence(spark, docs, labels)], "host string, path string, p double"))
    known = {(r.host, r.path): r for r in sums.collect()}
    for r in single:
        out, site, p = ps[r.doc_id][0], known[(r.source, r.lang)], r.ps[0]
        host = (site.hs - p + site.hk * share) / (site.hn - 1 + site.hk)
        p_site = (site.s - p + site.k * host) / (site.n - 1 + site.k)
        odds = [math.log(v / (1 - v)) for v in (min(1 - 1e-9, max(1e-9, v)) for v in (p, p_site, share))]
        assert out.p_site == pytest.approx(p_site) and out.p_good == pytest.approx(1 / (1 + math.exp(-(odds[0] + odds[1] - odds[2]))))
    lone = ps[500][0]
    assert lone.p_site == pytest.approx(share), "a document alone on its host says nothing about it"


def evidence(spark, docs, labels):
    """(host, path, p) of every row, by the model alone."""
    sample = qc.labelled_sample(labels, qc.Fitting())
    words = qc.lexicon(docs.select("doc_id", "text"), sample, qc.Fitting())
    rows = qc.featured(docs, words, "source", "lang").collect()
    first = {}
    for r in rows:
        first[r.doc_id] = min(first.get(r.doc_id, r.x), r.x)
    known = [(first[r.doc_id], r.quality, r.toxic) for r in sorted(sample.collect(), key=lambda r: r.doc_id)]
    quality, toxic = (qc.fit([k[0] for k in known], [k[i] for k in known], qc.Fitting().ridge) for i in (1, 2))

    def chance(model, x):
        odds = min(30.0, max(-30.0, model.intercept + sum(w * v for w, v in zip(model.weights, x))))
        return 1 / (1 + math.exp(-odds))

    return [(r.host, r.path, chance(quality, r.x) * (1 - chance(toxic, r.x))) for r in rows]

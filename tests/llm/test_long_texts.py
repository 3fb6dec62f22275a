"""Very long texts: time grows with the text, not with its square, and the result is the same as for short ones."""

import time

from pyspark.sql import functions as F

from rivermeld.llm.license_scan import recognised
from rivermeld.llm.line_dedup import without_repeats
from rivermeld.llm.secret_scan import scan


def seconds(spark, n):
    """Two documents of n lines, every second of which a third document on another site holds too."""
    shared = [f"shared line {k} of many" for k in range(0, n, 2)]
    rows = [(d, "\n".join(f"own {d} {k}\n{s}" for k, s in enumerate(shared)), f"s{d}") for d in (1, 2)] + [(0, "\n".join(shared), "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    docs.count()
    start = time.perf_counter()
    out, name = without_repeats(docs)
    got = {r.doc_id: r for r in out.select("doc_id", F.col(name)["n_lines"].alias("n"), F.col(name)["n_removed"].alias("gone"), F.col(name)["rest"].alias("rest")).collect()}
    took = time.perf_counter() - start
    docs.unpersist()
    return took, got


def test_line_dedup_of_80000_lines(spark):
    seconds(spark, 2_000)  # compiled before it is timed
    short, _ = seconds(spark, 20_000)
    long, got = seconds(spark, 80_000)
    assert long < 4.5 * max(short, 1.0)
    assert got[1].n == 80_000 and got[0].gone == 0
    assert got[1].rest.split("\n")[0] == "own 1 0"


def secrets(spark, n):
    """One text of n assignments between words outside ASCII."""
    docs = spark.createDataFrame([(1, "é token=abcdef12 " * n, "s", "en")], "doc_id long, text string, source string, lang string").cache()
    docs.count()
    start = time.perf_counter()
    spans = scan(docs).first()["assign"]
    took = time.perf_counter() - start
    docs.unpersist()
    return took, spans


def test_secret_scan_of_40000_hits(spark):
    secrets(spark, 1_000)
    short, _ = secrets(spark, 10_000)
    long, spans = secrets(spark, 40_000)
    assert long < 4.5 * max(short, 1.0)
    assert [(x["start"], x["stop"]) for x in spans] == [(17 * k + 2, 17 * k + 16) for k in range(40_000)]


def test_licences_of_20000_notices(spark):
    def notices(n):
        docs = spark.createDataFrame([(1, "Some words here.\nLicensed under the MIT license.\n" * n)], "doc_id long, text string").cache()
        docs.count()
        start = time.perf_counter()
        row = recognised(docs).first()
        docs.unpersist()
        return time.perf_counter() - start, row

    notices(500)
    short, _ = notices(5_000)
    long, row = notices(20_000)
    assert long < 4.5 * max(short, 1.0)
    assert (row["n_sentences"], row["licenses"]) == (20_000, "MIT")

"""The stages against SQL and brute force, each on its own input."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_near_duplicates import brute
from test_tokens import check_packing

import corpus_pipeline
from rivermeld.llm import decontamination, line_dedup, quality_rules
from rivermeld.llm.shared import table
from rivermeld.session import written

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = table(spark, SF_DIR, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, SF_DIR), "step")
        out.append((docs, after))
        docs = after
    return out


def sql(oracle, frame):
    con = duckdb.connect()
    con.register("documents", frame.toArrow())
    return {r[0]: r for r in con.execute(oracle).fetchall()}


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


def test_quality_rules(steps):
    before, after = steps[0]
    judged = sql(quality_rules.ORACLE, before)
    assert set(by_id(after)) == {k for k, r in judged.items() if r[7]}
    old = by_id(before)
    for k, r in by_id(after).items():
        lines = [x for x in old[k]["text"].split("\n") if x.strip()]
        kept = r["text"].split("\n")
        assert len(lines) - len(kept) == judged[k][8] and set(kept) <= set(lines) and r["n_chars"] == len(r["text"])


def test_line_dedup(steps):
    import hashlib

    before, after = steps[1]
    judged, left = sql(line_dedup.ORACLE, before), by_id(after)
    for k, r in judged.items():
        if r[2] == r[1] > 0:
            assert k not in left
        else:
            assert hashlib.md5(left[k]["text"].encode()).hexdigest() == r[3]


def test_near_duplicates(steps):
    before, after = steps[2]
    want = brute([(r["doc_id"], r["text"]) for r in before.collect()])
    assert set(by_id(after)) == {k for (k, _), (_, component) in want.items() if k == component}


def test_decontamination(spark, steps):
    before, after = steps[3]
    con = duckdb.connect()
    con.register("documents", before.toArrow())
    con.register("benchmark", table(spark, SF_DIR, "benchmark").toArrow())
    judged = {r[0]: r for r in con.execute(decontamination.ORACLE).fetchall()}
    left, old = by_id(after), by_id(before)
    assert set(left) == {k for k, r in judged.items() if not r[5]}
    for k, r in left.items():
        words = decontamination.item_words(r["text"])
        assert len(words) == judged[k][1] - judged[k][2] or judged[k][2] == 0
        assert judged[k][2] > 0 or r["text"] == old[k]["text"]


def test_packing(steps):
    before, after = steps[4]
    check_packing(after.collect(), {r["doc_id"]: r["text"] for r in before.collect()}, 1)


def test_columns_stay_until_the_last_stage(steps):
    names = steps[0][0].columns
    assert all(after.columns == names for _, after in steps[:-1])


def test_odd_rows_run_through(spark, tmp_path):
    texts = [None, "", "x", "Some line of the text here, number one.\n" * 3] + [
        " ".join(f"w{(k * 7 + j * j) % 997}" for j in range(90)) + "." for k in range(6)] * 2
    n = len(texts)
    frame = {"doc_id": pa.array([None if k == 5 else k % (n - 2) for k in range(n)], pa.int64()), "text": pa.array(texts, pa.string()),
             "lang": pa.array([None] * n, pa.string()), "source": pa.array([None] * n, pa.string()), "n_chars": pa.array([None] * n, pa.int64()),
             "verdict": pa.array(["v"] * n), "f1": pa.array(["f"] * n), "row": pa.array([None] * n, pa.int32())}
    pq.write_table(pa.table(frame), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())}), tmp_path / "benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 6
    pq.write_table(pa.table(frame).slice(0, 0), tmp_path / "documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

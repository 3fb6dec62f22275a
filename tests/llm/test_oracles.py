"""Queries with SQL against DuckDB, on the smallest tables and on a folder of odd rows."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import compare, connect

from rivermeld.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
KEY = "AKIA" + "B" * 16
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
LONG = " ".join(f"word{k} and more text" for k in range(40)) + "."
GRANT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
         "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
         "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to "
         "permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
         "The above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.")
TEXTS = [
    None, "", " \t\r\n\x0b\x0c ", "one", "one two", "a b c", "a b c a b c a b c " * 20, "x\n\nx\n x\nx ", LONG, LONG + "\n" + LONG, LONG,
    f"é🙂 password = 'abcdef123' Token:\"zzzzzz\" {KEY} {'0a' * 12} end", "password=token=abcdefg secret: ab api_key=abcdef PASSWD==x_y.zz",
    f"token: abcdef\ntoken: abcdef {KEY}{KEY} AKIAshort {'f' * 23} {'f' * 24}g{'a' * 30}", "ghp_" + "a" * 36 + " xoxb-1234567890-x -----BEGIN RSA PRIVATE KEY-----",
    "Home | News | About | Contact\n" + LONG, "WHAT!! A!! SHOUT!!\n" * 20, "Was Was Was Was and and and\n" * 15, "%%% ### $$$ &&& word%%% word###\n" * 12,
    "Accept all cookies.\nRead more\n" + LONG, "no end mark here\n" + LONG + "\nalso none", ITEM, ITEM.upper().replace(" ", "--") + "!", "alpha beta gamma", "before beta, Gamma after",
    "x " * 400 + ITEM, "lambda mu nu xi omicron", "The boiler line stands here.\n" + LONG, "The boiler line stands here.\nmore text of its own.",
    " The boiler line stands here.\t\nanother", "The boiler line stands here.", "short\nlines\nof a\npassage\n" + "that all repeat and are long enough together to be seen as one " * 4,
    "own\nshort\nlines\nof a\npassage\n" + "that all repeat and are long enough together to be seen as one " * 4, "Released under the MIT License.", GRANT,
    "text.\nLicensed under the Apache License, Version 2.0. All rights reserved.", "you may not use this file except in compliance with the License. x. You may obtain a copy of the License at\n\n http://",
    "a b c d e", "ſecret=abcdefgh toKen=abcdefgh", "\x1cone\x1d two three", "null\x00byte here",
]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    n = len(TEXTS)
    rows = [(k if k % 9 else None, t, None if k % 11 == 0 else "en", f"s{k % 7}" if k % 5 else None) for k, t in enumerate(TEXTS)]
    rows += rows[8:14] + [(100 + k, "The boiler line stands here.\nunique %d stays." % k, "de", f"s{k}") for k in range(8)]
    columns = {"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()),
               "lang": pa.array([r[2] for r in rows], pa.string()), "source": pa.array([r[3] for r in rows], pa.string()),
               "n_chars": pa.array([len(r[1] or "") for r in rows], pa.int64())}
    columns |= {name: pa.array([str(k) for k in range(len(rows))]) for name in ("verdict", "hits", "lines", "f1", "words_", "kept", "n_words")}
    pq.write_table(pa.table(columns), f"{folder}/documents.parquet")
    items = [(1, ITEM), (2, "alpha beta gamma"), (2, "alpha beta gamma"), (3, None), (4, " ,. "), (None, "beta gamma"), (10, "mu nu xi omicron pi"),
             (5, " ".join(reversed(ITEM.split())) + " alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu")]
    pq.write_table(pa.table({"item_id": pa.array([i for i, _ in items], pa.int64()), "text": pa.array([t for _, t in items], pa.string())}),
                   f"{folder}/benchmark.parquet")
    judged = [(k if k % 10 else None, k % 3 if k % 7 else None, k % 2 if k % 5 else None) for k in range(n)] + [(3, 1, 0), (3, 0, 1), (9000, 1, 1)]
    pq.write_table(pa.table({c: pa.array([r[i] for r in judged], pa.int64()) for i, c in enumerate(("doc_id", "quality", "toxic"))}
                            | {"part": pa.array(["x"] * len(judged))}), f"{folder}/labels.parquet")
    return folder, n


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    ok, note = compare(spark, connect(SF_DIR), name, QUERIES[name], ORACLES[name], SF_DIR)
    assert ok, note


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_odd_rows_equal_sql(spark, odd, name):
    ok, note = compare(spark, connect(odd[0]), name, QUERIES[name], ORACLES[name], odd[0])
    assert ok, note


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_empty_tables_give_no_rows(spark, odd, name, tmp_path):
    for t in ("documents", "benchmark", "labels"):
        pq.write_table(pq.read_table(f"{odd[0]}/{t}.parquet").slice(0, 0), os.path.join(tmp_path, f"{t}.parquet"))
    assert QUERIES[name](spark, str(tmp_path)).count() == 0

import os
import sys

import pytest

TOP = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
for path in (TOP, os.path.join(TOP, "tests")):
    if path not in sys.path:
        sys.path.insert(0, path)

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture
def docs(spark):
    """Makes a documents frame from (doc_id, text, source) rows, with a clashing extra column."""

    def make(rows, columns="doc_id long, text string, lang string, source string, n_chars long, f1 string, hits string, verdict string"):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x", "y", "z") for r in rows]
        return spark.createDataFrame(full, columns)

    return make

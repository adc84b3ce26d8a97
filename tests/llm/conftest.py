import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def documents(spark):
    """Makes a documents table from (doc_id, text, source) rows, with a column that clashes with inner names."""

    def make(rows):
        full = [(i, t, "en", s, None if t is None else len(t), "x") for i, t, s in rows]
        return spark.createDataFrame(full, SCHEMA + ", size string")

    return make

"""Small tables with the awkward rows: nulls, empty and long texts, repeated rows, clashing column names."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) pairs, with columns whose names operators use inside."""
    def make(rows):
        schema = "doc_id bigint, text string, label string, score string, kinds string, found string"
        return spark.createDataFrame([(i, t, "x", "y", "z", "w") for i, t in rows], schema)

    return make

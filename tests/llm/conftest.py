import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, keys string, word string"


@pytest.fixture
def docs(spark):
    """Documents with some extra columns whose names the operators use inside."""

    def make(*rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t) if t else None, 1, "k", "w") for i, t in rows], DOCS).repartition(3)

    return make


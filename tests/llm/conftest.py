import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SCHEMA = "doc_id bigint, text string, lang string, id string, digest string, window string"


@pytest.fixture(scope="session")
def frame(spark):
    """Rows (id, text) as a table with extra columns whose names the operators use themselves."""

    def make(rows):
        return spark.createDataFrame([(i, t, "xx", "clash", None, "w") for i, t in rows], SCHEMA)

    return make

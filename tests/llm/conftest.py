import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, spans string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of (id, text) or (id, text, source), with columns whose names clash."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x", None) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make

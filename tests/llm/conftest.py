import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@pytest.fixture()
def frame(spark):
    """Documents of (id, text), with columns whose names operators might use themselves."""

    def make(rows, lang=None, source=None):
        full = [(i, t, (lang or {}).get(i, "en"), (source or {}).get(i, "s0"), len(t or ""), 1, "k", 2, 3, "x") for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, id long, k string, shard int, n_lines int, g string")

    return make

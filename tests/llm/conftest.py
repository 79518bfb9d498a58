import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[2])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text, lang, source) tuples; short tuples are filled with NULLs."""

    def make(rows):
        rows = [(*row, *[None] * (4 - len(row))) for row in rows]
        return spark.createDataFrame([(*r, len(r[1]) if r[1] else 0) for r in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def clashing():
    """Adds columns whose names the operators use themselves."""
    names = "id row print shard taken kept size body n same bytes position before window _hash _size _id".split()

    def add(df):
        for number, name in enumerate(names):
            df = df.withColumn(name, df["doc_id"] * 0 + number)
        return df

    return add

"""Registered queries against their SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from nivo.llm.oracle import ORACLES

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def same(a, b):
    return math.isclose(a, b, rel_tol=1e-12) if isinstance(a, float) and isinstance(b, float) else a == b


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    df = entry.queries()[name](spark, SF)
    order = sorted(df.columns)
    found = sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr)
    result = duck.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == order
    wanted = sorted((tuple(r[names.index(c)] for c in order) for r in result.fetchall()), key=repr)
    assert len(found) == len(wanted)
    for x, y in zip(found, wanted):
        assert all(same(a, b) for a, b in zip(x, y)), (x, y)


def test_all_queries_of_the_subpackage_are_registered():
    names = entry.queries().keys()
    assert "pipeline" in names and {n for n in names if n.startswith("op")} >= set(ORACLES)

"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from arcstep.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
#: A cross-section that runs quickly; the driver compares all of them.
NAMES = ("graph_adjacency", "graph_updates", "walk_edges", "def_use", "block_purity", "merge_blocks", "dot_text", "build_edges", "recovered_switches", "alias_sets", "empty_block_bypass", "graph_diff")

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def canonical(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]
    return sorted(str(tuple(None if pd.isna(v) else (int(v) if isinstance(v, float) and v == int(v) else v) for v in r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    assert canonical(catalog.queries()[name](spark, DATA).toPandas()) == canonical(con.execute(catalog.oracle_sql()[name]).df())


def test_every_query_has_sql_but_the_known_ones():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"loop_invariants", "depth_first_orders", "depth_first_walk", "simplified_programs"}

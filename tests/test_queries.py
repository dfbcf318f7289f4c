"""Every query that has SQL against DuckDB, and the others for rows."""

import duckdb
import pytest

from palimpsest.plans import oracle
from palimpsest.plans.queries import QUERIES

SQL = oracle.queries()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _sorted(rows, places):
    clean = [tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in places) for r in rows]
    return sorted(clean, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    got = df.collect()
    assert got
    if name in SQL:
        result = duck.execute(SQL[name])
        columns = [c[0] for c in result.description]
        assert sorted(columns) == sorted(df.columns)
        order = sorted(columns)
        assert _sorted(got, [df.columns.index(c) for c in order]) == _sorted(result.fetchall(), [columns.index(c) for c in order])


def test_both_outcomes_occur(spark, sf_dir):
    """A comparison proves little where a predicate never changes its mind."""
    for name, column in (("contradiction_flags", "contradiction"), ("multichannel_flags", "contradiction"), ("tension_split", "role"), ("feedback_delta", "effect"), ("gate_chain", "action"), ("soft_decision", "strengthen")):
        assert len({r[column] for r in QUERIES[name](spark, sf_dir).select(column).collect()}) > 1, name

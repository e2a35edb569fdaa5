"""Every query against the SQL that says the same."""

import math

import duckdb
import pytest

from ladderline.plans import catalogue

#: Queries that find nothing in the smallest tables.
MAY_BE_EMPTY = {"absorbed_cohort", "population_check"}
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if v is None:
            return ""
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.6f}"
        return f"{v:.6f}" if isinstance(v, (int,)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, spark, data, duck):
    df = catalogue.QUERIES[name](spark, data)
    got = [tuple(r) for r in df.collect()]
    if name not in catalogue.ORACLES:
        assert got
        return
    want = duck.execute(catalogue.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    want = want.fetchall()
    assert _rows(df.columns, got) == _rows(names, want)
    assert got or name in MAY_BE_EMPTY, "an empty result checks nothing"

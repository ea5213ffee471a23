"""Every registered query of the library against its SQL, and those without SQL for rows and schema."""

import decimal
import math

import duckdb
import pytest
from plumbline import catalog
from plumbline.plans import inspect

#: Queries whose plan joins without an equality, and the side of it that does not grow.
BOUNDED = {
    "a30_permutation_test": "replicate numbers",
    "a36_stability_arm": "one row of totals",
    "a39_producer_gauges": "one row of totals",
    "a55_leave_one_group_out": "folds",
    "a63_balanced_subset": "one row of totals",
    "a65_leave_one_domain_out": "one row inside the model's fit",
    "g02_redundancy": "one row of totals",
    "g07_solved_residuals": "one row of totals",
    "g09_growth_preflight": "one row of totals",
    "j08_box_distance": "hulls, two for each volume",
    "j26_review_apply": "one row of violations",
    "p23_box_fits_volume": "the catalogue of volumes",
    "t05_dominated_by": "pairs of at most 1,024 cells",
    "u03_robust_members": "one row of totals",
    "w09_band_holdout": "one row of totals",
}
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def near(a, b):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return abs(a - b) <= 2e-5 * max(1, abs(a))
    return a == b


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sql, name):
    df = catalog.queries()[name](spark, DATA)
    assert name in BOUNDED or not inspect.nested_loops(df)
    rows, cols = df.collect(), sorted(df.columns)
    if name not in catalog.oracle_sql():
        assert rows
        return
    got = sql.execute(catalog.oracle_sql()[name])
    at = [c[0] for c in got.description]
    assert cols == sorted(at)
    want = sorted((tuple(plain(r[at.index(c)]) for c in cols) for r in got.fetchall()), key=repr)
    have = sorted((tuple(plain(r[c]) for c in cols) for r in rows), key=repr)
    assert len(have) == len(want)
    assert have == want or all(near(x, y) for a, b in zip(have, want, strict=True) for x, y in zip(a, b, strict=True))


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and set(catalog.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())

"""Every registered query with SQL against DuckDB on the smallest tables; the others give rows of a stable schema."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from helixframe import plans
from helixframe.sources.views import BASE

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in BASE:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, float):
        return repr(round(v, 5) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, con, name):
    df = plans.QUERIES[name](spark, SF)
    rows = df.collect()
    assert df.columns
    if name not in plans.ORACLES:
        return
    want = con.execute(plans.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(plain(r[n]) for n in names) for r in rows) == sorted(tuple(plain(v) for v in r) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def copied(spark, tmp_path_factory):
    """The smallest tables with three sites per position: parts and their lines again with keys 200,000 and 400,000 higher."""
    folder = tmp_path_factory.mktemp("copied")
    c = duckdb.connect()
    for t in BASE:
        key = {"part": "p_partkey", "lineitem": "l_partkey"}.get(t)
        rows = f"select b.* replace ({key} + 200000 * i as {key}) from range(3) r(i), '{SF}/{t}.parquet' b" if key else f"select * from '{SF}/{t}.parquet'"
        c.execute(f"copy ({rows}) to '{folder}/{t}.parquet' (format parquet)")
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return str(folder), c


@pytest.mark.parametrize("name", [n for n in sorted(plans.QUERIES) if n in {"a38_diff_site_discordance", "a39_diff_indv_discordance", "a40_diff_discordance_matrix", "a44_non_ref_discordance"} or n.startswith("a44_compare_")])
def test_query_with_sites_at_one_position(spark, copied, name):
    folder, c = copied
    df = plans.QUERIES[name](spark, folder)
    want = c.execute(plans.ORACLES[name])
    names = [x[0] for x in want.description]
    assert sorted(tuple(plain(r[n]) for n in names) for r in df.collect()) == sorted(tuple(plain(v) for v in r) for r in want.fetchall())


@pytest.mark.parametrize("name", ["n9_phased_join", "n9_joined_calls"])
def test_phase_with_sites_at_one_position(spark, copied, name):
    test_query_with_sites_at_one_position(spark, copied, name)

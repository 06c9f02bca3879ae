from functools import cache

import pytest

import __spark_entry__ as entry
from plumbline.plans import queries
from plumbline.plans.queries import ORACLE_SQL, QUERIES
from tests.conftest import SMALL
from tests.oracle import connect, same_rows


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.fixture(scope="module", autouse=True)
def one_lattice(spark):
    """The lattice is derived once for all queries of this module."""
    whole = queries.lattice
    queries.lattice = cache(whole)
    yield
    queries.lattice = whole


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    same_rows(QUERIES[name](spark, SMALL), con, ORACLE_SQL[name])


def test_entry(spark):
    assert entry.entry(spark).columns == ["source_id", "pos", "target_ref", "target_id", "state", "expected", "actual"]
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())


def test_impact_over_the_star_goes_down_to_lineitem(spark, con):
    affected = "select distinct l_orderkey, l_linenumber from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where n_regionkey = 1"
    got = {r.id for r in QUERIES["impact_star_lineitem"](spark, SMALL).where("depth = 4").collect()}
    want = {f"lineitem-{o}-{n}" for o, n in con.execute(affected).fetchall()}
    assert want and got == want

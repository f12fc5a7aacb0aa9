"""Every registered query against its SQL on the small tables."""

import pytest

from millpond.plans import COVERS, PLANS, SQL, load_all
from tests.oracle import compare, connect

load_all()


@pytest.fixture(scope="module")
def duck(request):
    con = connect("/root/testdata/sf0.001")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(PLANS))
def test_query(spark, duck, small, name):
    if name in SQL:
        problem = compare(spark, duck, small, PLANS[name], SQL[name])
        # A few filters find nothing in the smallest tables; both sides agree then.
        assert problem in (None, "no rows"), problem
    else:
        assert PLANS[name](spark, small).count() > 0


def test_only_approximate_queries_have_no_sql():
    assert {n for n in PLANS if n not in SQL} == {"approximate_measures", "nearest_vectors_by_hash"}


def test_every_query_names_what_it_covers():
    assert all(COVERS[n] for n in PLANS)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

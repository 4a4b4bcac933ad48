"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import check
from hitledger.plans import all_queries

SF = "/root/testdata/sf0.001"
QUERIES = all_queries()


@pytest.fixture(scope="module")
def duck():
    return check.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    q = QUERIES[name]
    got = q.run(spark, SF).toArrow()
    assert got.column_names == [c for c, _ in q.columns]
    if q.sql is None:
        assert got.num_rows > 0
        return
    assert check.compare(got, duck.sql(q.oracle()).to_arrow_table()) is None


def test_ids_are_covered():
    """Every operator id of the blueprint has a query."""
    want = {
        **{"S": 15, "P": 38, "F": 6, "J": 20, "A": 39, "W": 14, "T": 9, "U": 5, "B": 22, "E": 23},
        **{"R": 11, "M": 10, "G": 8, "Q": 16, "X": 10},
    }
    ids = {i for q in QUERIES.values() for i in q.ids}
    missing = [f"{k}{n:02d}" for k, top in want.items() for n in range(1, top + 1) if f"{k}{n:02d}" not in ids]
    assert missing == []

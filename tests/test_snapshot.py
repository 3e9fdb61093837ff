"""A snapshot's pages equal those of the plain search."""

import pytest

from rankfield.operators import rank
from rankfield.plans import queries, snapshot
from rankfield.sources.adapters import tree_rows


@pytest.fixture(scope="module")
def built(spark, small):
    return snapshot.build(tree_rows(spark, small))


@pytest.mark.parametrize("q", ["0012", "customer#0000", "low", "o", "nat", "crc", "sia", "zzz", "", "5-l", "ord_"])
def test_pages(spark, small, built, q):
    plain = rank.search(queries.tree_entries(spark, small), q, 32)
    got = [(r["frn"], round(r["score"], 9)) for r in snapshot.search(built, q).collect()]
    assert got == [(r["frn"], round(r["score"], 9)) for r in plain.collect()]

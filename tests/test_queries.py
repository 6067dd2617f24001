"""Every query of the catalogue beside its SQL, on small tables."""

import pytest
from oracle import compare, connect

from stareflow.plans import catalogue


#: The smallest tables hold no renumbered section, and none of the words searched for.
LARGER = {"renumber_chains", "renumber_links", "word_search"}


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, sf, name):
    folder = sf.replace("0.001", "0.01") if name in LARGER else sf
    sql = catalogue.ORACLE_SQL.get(name)
    ok, n, why = compare(spark, connect(folder), catalogue.QUERIES[name], sql, folder)
    assert ok is not False, why
    assert n > 0

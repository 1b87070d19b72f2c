"""Every query of the library against its SQL, over whole tables."""

import oracle
import pytest

from onomast.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, sf, name):
    assert oracle.rows_of(catalog.QUERIES[name](spark, sf)) == oracle.rows_of_sql(oracle.connect(sf), catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_gives_rows(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == len(catalog.CANDIDATES)
    assert set(e.oracle_sql()) <= set(e.queries())


def test_results_do_not_depend_on_partitions(spark, sf):
    got = []
    for n in ("1", "7", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append([oracle.rows_of(catalog.QUERIES[q](spark, sf)) for q in ("build_triplets", "stratified_split", "mine_sampled")])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1] == got[2]

import pytest
from compare import expected, rows_of
from conftest import SF

from tidewell.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert rows_of(QUERIES[name](spark, SF)) == expected(SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_points():
    import __spark_entry__ as entry

    assert set(SQL) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("partitions", [1, 7])
def test_results_do_not_depend_on_partitions(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for name in ("cluster_greedy", "hide_propagate", "auc_per_story"):
            assert rows_of(QUERIES[name](spark, SF)) == expected(SQL[name], SF)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)

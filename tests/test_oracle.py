import os

import pytest
from oracle import DATA, connect, same

from cograph import queries, round_trips  # noqa: F401  registers its queries

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, con, name):
    same(spark, con, queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL) - {"knn_classify", "tier_rollup", "single_call"}))
def test_partitions_do_not_matter(spark, name):
    first = sorted(map(str, queries.QUERIES[name](spark, DATA).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert first and first == sorted(map(str, queries.QUERIES[name](spark, DATA).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())

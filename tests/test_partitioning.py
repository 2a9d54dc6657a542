"""Results do not depend on the number of shuffle partitions."""

import pytest

import __spark_entry__ as E

from tablepaths import SF001

QUERIES = ["rfm_segment_summary", "split_stratified", "auc_exact", "describe_orders", "dedupe_lineitem",
           "entity_scorecard"]


def _rows(spark, name):
    return sorted(tuple(r) for r in E.queries()[name](spark, SF001).collect())


@pytest.mark.parametrize("name", QUERIES)
def test_same_result_with_1_and_8_partitions(spark, name):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = _rows(spark, name)
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        eight = _rows(spark, name)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert one == eight

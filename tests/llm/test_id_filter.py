"""Rows are told apart by a filter of ids before a join, so that others are not shuffled."""


def test_filter_holds_every_id_and_no_null(spark):
    from pyspark.sql import functions as F

    from parley.llm.store import id_filter, may_hold

    ids = spark.range(2**60, 2**60 + 500)
    rows = spark.range(2**60, 2**60 + 20_000).unionByName(spark.createDataFrame([(None,)], "id long"))
    passed = {r.id for r in rows.where(may_hold(id_filter(ids, always=True), F.col("id"))).collect()}
    assert set(range(2**60, 2**60 + 500)) <= passed and len(passed) < 8_000 and None not in passed

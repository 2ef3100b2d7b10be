"""Tables that are written leave no shuffle files behind."""

from parley.llm import store


def test_shuffle_files_go_with_the_write(spark, tmp_path):
    block_manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager()
    held = lambda: {f for f in block_manager.diskBlockManager().getAllBlocks().mkString("\n").split("\n") if f.startswith("shuffle_")}
    before, setting = held(), spark.conf.get(store.CLEANUP, "false")
    rows = spark.range(50_000).repartition(3, "id").groupBy((store.F.col("id") % 7).alias("k")).count()
    table = store.materialise(rows, "rows")
    assert held() <= before and spark.conf.get(store.CLEANUP, "false") == setting
    assert sorted(r["count"] for r in table.collect()) == sorted(r["count"] for r in rows.collect())
    again = store.materialise(rows, "again")
    assert again.count() == 7
    store.discard(table)
    store.discard(again)

import os

from draftloom.llm import shared


def test_tables_live_in_the_shared_folder_until_cleared(spark):
    df = shared.as_table(spark.range(5).withColumnRenamed("id", "doc_id"), "t")
    assert df.count() == 5 and df._table_path.startswith(shared.shared_dir(spark)) and spark.sparkContext.applicationId in df._table_path
    shared.drop_table(df)
    kept = shared.as_table(spark.range(3), "t")
    shared.clear_tables(spark)
    assert not os.path.exists(kept._table_path.removeprefix("file://").removeprefix("file:"))


def test_batches_are_small_unless_set(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, "77")
    shared.small_batches(spark.range(1))
    assert spark.conf.get(key) == "77"
    spark.conf.set(key, "10000")
    shared.small_batches(spark.range(1))
    assert spark.conf.get(key) == str(shared.BATCH_ROWS)
    spark.conf.set(key, was)

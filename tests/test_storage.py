import time

from pyspark.sql import functions as F

from textloom.plans.storage import stored


def _shuffle_files(spark) -> set[str]:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_a_stored_table_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    made = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left
    assert {(r["k"], r["count"]) for r in made.collect()} == {(k, 143 if k < 6 else 142) for k in range(7)}

"""Texts of file sets cost by the files of a row, not by all files there are."""

import time

from pyspark.sql import functions as F

from anualia.plans import payroll


def seconds(spark, n_files):
    names = [f"f{i:04d}.csv" for i in range(n_files)]
    masks, text = payroll._file_masks(names)
    df = spark.range(40_000).select("id", (F.col("id") % n_files).cast("int").alias("_file")).groupBy("id").agg(*masks).select("id", text.alias("files"))
    found = {r.files for r in df.where("id < 2000").collect()}
    assert found == set(names[:2000])
    start = time.monotonic()
    df.write.format("noop").mode("overwrite").save()
    return time.monotonic() - start


def test_rows_do_not_pay_for_files_of_others(spark):
    assert seconds(spark, 1_000) < 5 * seconds(spark, 60) + 2

"""Reports: many tasks, and rows into which no cell reaches."""

import time

from pyspark.sql import functions as F

from anualia.functions import markup
from workload import adapters as a

SF = "/root/testdata/sf0.001"


def test_tasks_grow_with_the_reports(spark, monkeypatch):
    n = spark.read.parquet(f"{SF}/orders.parquet").count()
    want = [tuple(r) for r in a.receipts(spark, SF).orderBy("ord").collect()]
    assert [tuple(r) for r in a.spread_receipts(spark, SF).orderBy("ord").collect()] == want
    monkeypatch.setattr(a, "REPORTS_A_TASK", 10)
    for pages in (a.report_pages, a.spanned_pages, a.nested_pages):
        assert pages(spark, SF).rdd.getNumPartitions() == -(-n // 10)


def test_a_wide_row_below_no_spanning_cell_is_not_placed_cell_by_cell(spark):
    wide = "<tr>" + "<td>x</td>" * 12_000 + "</tr>"
    df = spark.createDataFrame([("<tr><td rowspan=1>a</td></tr>", wide)], "top string, wide string")
    start = time.monotonic()
    rows = df.select(markup.filled_rows(F.array("top", "wide")).alias("r")).first().r
    assert rows == ["<tr><td>a", "<tr>" + "<td>x" * 12_000]
    assert time.monotonic() - start < 4

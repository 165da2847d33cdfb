"""The rental sheet: wide rows are neither shuffled for a join nor computed twice for a sort."""

from contextlib import redirect_stdout
from io import StringIO

from pyspark.sql import functions as F

from anualia.functions.amounts import clean_amount_plain
from anualia.operators.sequence import number_rows
from workload import adapters as a

SF = "/root/testdata/sf0.001"


def plan(df):
    out = StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_rows_are_numbered_after_they_were_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def costly(x):
        seen.add(1)
        return x % 7

    rows = number_rows(spark.range(1000).repartition(4).select("id", costly.asNondeterministic()("id").alias("k")), [F.col("k"), F.col("id")], "n")
    assert [(r.k, r.id) for r in rows.orderBy("n").collect()] == sorted((i % 7, i) for i in range(1000))
    assert seen.value == 1000


def test_places_are_broadcast_unless_there_are_very_many(spark, monkeypatch):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        few = a.rental_sheet(spark, SF)
        assert "l_suppkey" not in "".join(line for line in plan(few).splitlines() if "SortMergeJoin" in line)
        monkeypatch.setattr(a, "BROADCAST_PLACES", 3)
        many = a.rental_sheet(spark, SF)
        assert "SortMergeJoin [l_suppkey" in plan(many)
        assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
    finally:
        spark.conf.set(key, before)


def test_missing_amounts_are_zero(spark):
    df = spark.createDataFrame([(None,), ("",), ("1.234",), ("x",)], "a string")
    assert [r[0] for r in df.select(clean_amount_plain("a")).collect()] == [0, 0, 1234, 0]

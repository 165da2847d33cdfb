"""Scans of very small splits."""

from anualia.sources import listing, quoted_records


def test_tasks_grow_with_the_files_and_not_with_the_splits(spark, tmp_path):
    want = [f"line {i}" for i in range(5_000)]
    (tmp_path / "a.csv").write_text("\n".join(want[:3_000]) + "\n")
    (tmp_path / "b.csv").write_text("\n".join(want[3_000:]) + "\n")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "100b")
    try:
        lines = quoted_records.text_lines(spark, [str(tmp_path)])
        tasks = lines.rdd.getNumPartitions()
        rows = lines.orderBy("file_path", "file_block_start", "row").collect()
    finally:
        spark.conf.set(key, before)
    assert [r.value for r in rows] == want and len({(r.file_path, r.file_block_start) for r in rows}) > 300
    assert tasks <= 4 * spark.sparkContext.defaultParallelism


def test_sizes_of_settings():
    assert [listing._bytes(s) for s in ("134217728b", "64k", "16MB", "100")] == [128 << 20, 64 << 10, 16 << 20, 100]

"""Small files are read many to a task, and in bounded batches."""

from larkmill.sources.readers import read_documents


def test_small_files_share_tasks(spark, tmp_path):
    for k in range(200):
        (tmp_path / f"{k % 7}").mkdir(exist_ok=True)
        (tmp_path / f"{k % 7}" / f"{k}.txt").write_text(f"text {k}")
    found = read_documents(spark, str(tmp_path))
    assert {r["text"] for r in found.collect()} == {f"text {k}" for k in range(200)}
    assert found.rdd.getNumPartitions() == 4  # seven partitions of 32 files at most in the scan
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000

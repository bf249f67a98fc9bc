"""A status of resumes needs no chunks and stores no texts; chunks are made once when they are asked for."""

from larkmill.operators.pipelines import ingest_resumes


def test_chunks_are_made_when_asked_for(spark):
    files = spark.createDataFrame([(1, "python " * 80), (2, "PYTHON " * 80), (3, "me@a.org sql " * 40)], "resume_id long, text string")
    done = ingest_resumes(files, spark.createDataFrame([], "content_hash string"))
    assert {r["resume_id"]: r["status"] for r in done.parents.collect()} == {1: "created", 2: "duplicate", 3: "created"}
    assert "chunks" not in vars(done) and "ExistingRDD" not in done.parents.where("resume_id = 1")._jdf.queryExecution().optimizedPlan().toString()
    assert {r["resume_id"] for r in done.chunks.collect()} == {1, 3} and done.chunks is done.chunks
    assert done.vectors.count() == done.chunks.count()

"""All-or-nothing output: failed tasks and jobs leave the table as it was."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.sources import published as pb


def rows(spark, path, version=None):
    return sorted(r.id for r in pb.published(spark, path, version).collect())


def test_versions_replace_and_add(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        pb.published(spark, path)
    pb.publish(spark.range(10).repartition(3), path)
    first = pb.published(spark, path)
    pb.publish(spark.range(20, 25), path)
    pb.publish(spark.range(30, 31), path, overwrite=False)
    assert rows(spark, path) == [*range(20, 25), 30] and rows(spark, path, 1) == list(range(10))
    assert first.count() == 10  # a reader keeps its own files
    with pytest.raises(Exception, match="other columns"):
        pb.publish(spark.range(3).withColumn("x", F.lit(1)), path, overwrite=False)
    assert rows(spark, path) == [*range(20, 25), 30]
    assert pb.remove_unlisted(path) > 0 and rows(spark, path) == [*range(20, 25), 30]
    pb.publish(spark.range(0), path)
    assert rows(spark, path) == [] and pb.manifest(path)["version"] == 4


def test_a_task_that_dies_after_writing_leaves_the_old_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    pb.publish(spark.range(10), path)
    fail = F.udf(lambda i: 1 // (i - 39), "long")
    with pytest.raises(Exception, match="ZeroDivision|division"):
        pb.publish(spark.range(40).repartitionByRange(4, "id").select((fail("id") * 0 + F.col("id")).alias("id")), path)
    assert rows(spark, path) == list(range(10)) and pb.manifest(path)["version"] == 1


def test_a_job_that_dies_before_it_publishes_leaves_the_old_rows(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    pb.publish(spark.range(10), path)
    writer = pb.PublishedWriter(path, spark.range(1).schema, True)
    import pyarrow as pa

    writer.write(iter([pa.RecordBatch.from_pydict({"id": [99]})]))  # staged, then nothing: the process is gone
    (tmp_path / "t/manifests/.half").write_text("{")  # and one that died while it wrote its manifest
    assert len(os.listdir(tmp_path / "t/data")) > len(pb.manifest(path)["files"])
    assert rows(spark, path) == list(range(10))
    pb.publish(spark.range(3), path)
    assert rows(spark, path) == [0, 1, 2]
    pb.remove_unlisted(path)
    assert len(os.listdir(tmp_path / "t/data")) == len(pb.manifest(path)["files"])


def test_filters_reach_the_files(spark, tmp_path):
    path = str(tmp_path / "t")
    pb.publish(spark.range(100).withColumn("x", F.col("id") * 2), path)
    df = pb.published(spark, path).where("id > 90").select("x")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,90)]" in plan and df.count() == 9

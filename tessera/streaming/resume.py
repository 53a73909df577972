"""Incremental runs: new input files are worked on once; a restart goes on where the last one ended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.io import remaining


def incremental(spark: SparkSession, source: str, schema: str, output: str, checkpoint: str, keys: list[str], work: Callable[[DataFrame], DataFrame]):
    """Run work over JSON files that source has gained, append Parquet to output, and return the finished query.

    Rows whose keys the output has are skipped, so a batch that is tried again adds nothing twice.
    """

    def each(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        fs_path = session._jvm.org.apache.hadoop.fs.Path(output)
        there = fs_path.getFileSystem(session._jsc.hadoopConfiguration()).exists(fs_path)
        todo = remaining(batch.dropDuplicates(keys), session.read.parquet(output), keys) if there else batch.dropDuplicates(keys)
        work(todo).write.mode("append").parquet(output)

    query = spark.readStream.schema(schema).json(source).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()
    return query

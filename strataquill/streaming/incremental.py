"""Incremental ingestion (an extension): new documents are chunked and appended once, keyed by doc_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataquill.plans.pipelines import build_chunks


def follow(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, condition=None):
    """A query that reads new Parquet files under source and appends their chunks. A replayed batch adds nothing, and
    neither does a doc_id that an earlier batch held; of several rows of one doc_id in a batch one counts."""

    def each(batch: DataFrame, epoch: int) -> None:
        where = spark._jvm.org.apache.hadoop.fs.Path(target)
        fresh = batch.dropDuplicates(["doc_id"])
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            held = spark.read.parquet(target)
            fresh = fresh.join(held.where(held.batch != epoch).select("doc_id").distinct(), "doc_id", "left_anti")
        build_chunks(fresh, condition).write.mode("overwrite").parquet(f"{target}/batch={epoch}")

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

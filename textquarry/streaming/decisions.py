"""Review decisions as a stream: a folder of JSON lines is watched, and each batch is merged into a state of the last decision by id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.review import last_by_id
from ..sources.tables import exists

SCHEMA = "sample_id string, human_label string, review_status string, reviewer string, review_note string, review_timestamp string"
FIELDS = ("human_label", "review_status", "reviewer", "review_note", "review_timestamp")


def read_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("mode", "FAILFAST").json(folder)


def state_path(folder: str, epoch: int) -> str:
    return f"{folder}/epoch={epoch}"


def upsert(state: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: epoch n's state is epoch n-1's with the batch's last decisions (by time stamp); writing it again gives the same files."""

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(state_path(state, epoch - 1)) if epoch and exists(spark, state_path(state, epoch - 1)) else spark.createDataFrame([], SCHEMA)
        rows = before.withColumn("_age", F.lit(0)).unionByName(batch.withColumn("_age", F.lit(1)))
        last = last_by_id(rows.withColumn("_order", F.struct("_age", F.coalesce("review_timestamp", F.lit("")), F.coalesce("review_status", F.lit("")))), FIELDS, "_order")
        last.write.mode("overwrite").parquet(state_path(state, epoch))

    return merge


def run(spark: SparkSession, folder: str, state: str, checkpoint: str) -> StreamingQuery:
    return read_decisions(spark, folder).writeStream.foreachBatch(upsert(state)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pending(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """A streaming or static queue without what is decided (a stream joins a static state)."""
    done = decisions.filter(F.col("review_status").isin("accepted_auto", "corrected", "skipped")).select(F.col("sample_id").alias("_id"))
    return queue.join(done, F.col("sample_id") == F.col("_id"), "left_anti")

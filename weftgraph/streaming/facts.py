"""Facts that keep coming: dependency rows from a stream, and module imports kept up to date.

The batch operators do the work; a stream only adds distinct facts. Rows are distinct within the
watermark; the sink is idempotent by batch id, so a batch that runs again after a failure adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

DEPS = "seen timestamp, dependee string, dependency string, kind string"


def deps_stream(spark: SparkSession, path: str, late: str = "1 hour") -> DataFrame:
    """Distinct (dependee, dependency, kind) rows of JSON files as they come; repeats within `late` go."""
    s = spark.readStream.schema(DEPS).json(path).withWatermark("seen", late)
    return s.dropDuplicatesWithinWatermark(["dependee", "dependency", "kind"])


def importance_stream(entries: DataFrame, every: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Inclusions of each header per window; entries(seen, header) as a stream."""
    return entries.withWatermark("seen", late).groupBy(F.window("seen", every), "header").agg(F.count("*").alias("n"))


def append_facts(stream: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """Adds the stream's rows to a Parquet table of facts, a folder a batch."""

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table_path}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

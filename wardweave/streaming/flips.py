"""A flip log as a stream: the last part of each node, kept up batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_flips(spark: SparkSession, path: str, schema: str = "chain long, step long, node_id long, part int") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def latest_parts(flips: DataFrame) -> DataFrame:
    """(chain, node_id, part): state is one row a node, whatever the length of the log."""
    return flips.filter("node_id is not null").groupBy("chain", "node_id").agg(F.max_by("part", "step").alias("part"), F.max("step").alias("step"))


def run_once(stream: DataFrame, name: str, mode: str = "complete") -> None:
    """Process all that is there into the memory table `name`."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()

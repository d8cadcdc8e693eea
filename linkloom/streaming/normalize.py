"""Normalization and exact blocking as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linkloom.plans.entities import RAW, normalized


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New entity tables of a folder, as they come."""
    return spark.readStream.csv(folder, sep="\t", header=True, quote="", schema=", ".join(f"{c} string" for c in RAW))


def normalized_stream(raw: DataFrame) -> DataFrame:
    """The same stateless projection as in batch."""
    return normalized(raw)


def candidates_stream(s1: DataFrame, targets: DataFrame, column: str = "name_alphanumeric") -> DataFrame:
    """Candidates of streamed S1 entities among stored targets: equal country and column."""
    stored = targets.where(f"country_cleaned <> '' and {column} <> ''").select("country_cleaned", column, F.col("entity_id").alias("cand_id"))
    return s1.join(stored, ["country_cleaned", column]).select(F.col("entity_id").alias("s1_id"), "cand_id")


def write_stream(frame: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return frame.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

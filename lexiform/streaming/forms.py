"""Incremental forms: the same relations over streams. Results equal those of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiform.operators.classes import flatten
from lexiform.sources.files import CLASS_SCHEMA


def read_classes(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream of classes from JSON lines that arrive in a folder."""
    return spark.readStream.schema(CLASS_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)


def form_counts(classes: DataFrame) -> DataFrame:
    """Running number of forms by track and notation."""
    return flatten(classes).groupBy("track", "notation").agg(F.count("*").alias("n"))


def first_texts(forms: DataFrame, time_col: str, delay: str = "1 hour") -> DataFrame:
    """Forms whose (fact_id, text) has not been seen within the watermark: state is bounded by the delay."""
    return forms.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["fact_id", "text"])


def windowed_counts(events: DataFrame, time_col: str, key: str, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Events by key and window; late rows beyond the delay are dropped."""
    return events.withWatermark(time_col, delay).groupBy(F.window(time_col, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")

"""Numbering and lookups that no frequent value and no single task holds up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiform.sources.shared import materialize

#: Fewer values than this may be called frequent, so that their rows can be broadcast.
FREQUENT = 4096


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it has fewer partitions than there are cores: for heavy work inside rows behind a small or undivided scan."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def numbered(df: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """df with ``name``: 0 for the first row in order, 1 for the next, over all rows. Rows are divided by ranges of the order and numbered inside them."""
    # Written: numbers and sizes have to come from one and the same division into ranges.
    rows = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = rows.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(before, F.lit(0)).alias("_before"))  # a row a range
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return rows.withColumn("_in", inside).join(F.broadcast(offsets), "_range").withColumn(name, F.col("_before") + F.col("_in") - 1).drop("_range", "_in", "_before")


def looked_up(rows: DataFrame, value: Column, table: DataFrame, key: str, result: str, name: str) -> DataFrame:
    """rows with ``name``: the table's result for the value, null without one. table: one row a key.

    Values of more than one row in FREQUENT are fewer than FREQUENT: their results are broadcast. Only rows of other values meet the
    table in a shuffle; rows that have no value or are done take a number of their own instead of a key there, which spreads them.
    """
    keyed = rows.withColumn("_value", value)
    sizes = materialize(keyed.filter("_value is not null").groupBy("_value").agg(F.count("*").alias("_n")), "value-sizes")
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    held = table.select(F.col(key).alias("_key"), F.col(result).alias("_result"))
    often = sizes.filter(F.col("_n") > max(1000, total // FREQUENT)).join(held, F.col("_value") == F.col("_key"), "left")
    often = often.select(F.col("_value").alias("_known"), F.col("_result").alias("_first"))
    keyed = keyed.join(F.broadcast(often), F.col("_value") == F.col("_known"), "left")
    asked = F.when(F.col("_known").isNull(), F.col("_value"))
    keyed = keyed.withColumn("_asked", asked).withColumn("_salt", F.when(F.col("_asked").isNull(), 1 + F.pmod(F.monotonically_increasing_id(), F.lit(FREQUENT))).otherwise(F.lit(0).cast("bigint")))
    held = held.withColumn("_none", F.lit(0).cast("bigint"))
    out = keyed.join(held.hint("merge"), (F.col("_asked") == F.col("_key")) & (F.col("_salt") == F.col("_none")), "left")
    return out.withColumn(name, F.coalesce("_first", "_result")).drop("_value", "_known", "_first", "_asked", "_salt", "_key", "_result", "_none")

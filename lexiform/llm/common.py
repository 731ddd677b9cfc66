"""Shared helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiform.sources.shared import discard, materialize, new_path

__all__ = ["bucketed", "discard", "drop_ids", "held_out", "iterator_udf", "join_stats", "let", "materialize", "prefix_sums", "small_batches", "table"]
#: Fewer keys than this may be called hot, so that their rows can be broadcast.
HOT_KEYS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucketed(df: DataFrame, name: str, key: str, buckets: int, codec: str = "zstd") -> DataFrame:
    """Like materialize(), but in buckets by key: what groups or joins the rows by that key needs no shuffle of them."""
    spark = df.sparkSession
    path = new_path(spark, name)
    known = path.rsplit("/", 1)[-1].replace("-", "_")
    df.write.bucketBy(buckets, key).option("path", path).option("compression", codec).saveAsTable(known, format="parquet")
    out = spark.table(known)
    spark.sql(f"DROP TABLE {known}")  # the catalog's entry goes; the files are outside its warehouse and stay
    out._lexiform_path = path
    return out


@contextmanager
def small_batches(spark: SparkSession, rows: int = 256) -> Iterator[None]:
    """Jobs inside send at most so many rows to Python at once: for rows that hold whole sets. The setting is restored.

    Elsewhere batches are bounded by bytes (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB unless set).
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def iterator_udf(f, kind: str):
    """An Arrow UDF from a function over an iterator of arrays; the hints are set here so that pyarrow is imported on use only."""
    import pyarrow as pa

    f.__annotations__ = {f.__code__.co_varnames[0]: Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(f, kind)


def let(value: Column, use) -> Column:
    """use(value) with value computed once a row, however often it is used, also inside lambdas."""
    return F.transform(F.array(value), use)[0]


def prefix_sums(values: Column, chunk: int = 64) -> Column:
    """array<bigint>: for each value of an array<bigint> the sum of those before it; linear in their number but for its square over chunk squared."""
    grow = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    start = lambda at: F.struct(at.alias("at"), F.array().cast("array<bigint>").alias("out"))
    zero = F.lit(0).cast("bigint")

    def of(v: Column) -> Column:
        part = lambda k: F.slice(v, k * chunk + 1, F.lit(chunk))
        chunks = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / chunk).cast("int"))
        sums = F.transform(chunks, lambda k: F.aggregate(part(k), zero, lambda a, x: a + x))
        bases = F.aggregate(sums, start(zero), grow, lambda acc: acc["out"])
        inside = F.transform(bases, lambda base, k: F.aggregate(part(k), start(base), grow, lambda acc: acc["out"]))
        return F.when(F.size(v) > 0, F.flatten(inside)).otherwise(F.array().cast("array<bigint>"))

    return let(values, of)


def join_stats(rows: DataFrame, stats: DataFrame, key: str, weight: str) -> DataFrame:
    """rows joined with a row a key. stats is written and counts in ``weight`` how many rows a key has.

    Keys with more than one row in HOT_KEYS are fewer than HOT_KEYS: they are broadcast, so that no
    hot key meets in one task; only rows of other keys are shuffled.
    """
    total = stats.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) > max(1000, total // HOT_KEYS)
    many = F.broadcast(stats.filter(hot))
    return rows.join(many, key).unionByName(rows.join(many.select(key), key, "left_anti").join(stats.filter(~hot), key))


def held_out(doc_id) -> F.Column:
    """Rows whose crc32(doc_id as text) mod 4 is 2; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def drop_ids(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", max_bits: int = 1 << 29) -> DataFrame:
    """docs without the rows whose id is in gone. A bitmap of hashed ids, of max_bits at most, lets most rows pass without a shuffle."""
    gone = materialize(gone.select(F.col(id_col).cast("long").alias("gone")).distinct(), "gone")
    bits = min(max_bits, max(1 << 16, 1 << (16 * gone.count()).bit_length()))
    slot = lambda c: F.xxhash64(c).bitwiseAND(F.lit(bits - 1))
    marks = gone.select(slot(F.col("gone")).alias("slot")).groupBy(F.expr("slot div 32768").alias("bucket")).agg(F.expr("bitmap_construct_agg(slot % 32768)").alias("marks"))
    cols = docs.columns
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in cols)).alias("row"), F.col(id_col).cast("long").alias("own"))
    rows = rows.withColumn("slot", slot(F.col("own"))).withColumn("bucket", F.expr("slot div 32768")).join(F.broadcast(marks), "bucket", "left")
    byte = "cast(conv(hex(substring(marks, cast(slot % 32768 div 8 as int) + 1, 1)), 16, 10) as int)"
    rows = rows.select("row", "own", F.expr(f"coalesce(shiftright({byte}, cast(slot % 8 as int)) & 1, 0) = 1").alias("maybe"))
    kept = rows.filter("maybe").join(gone, F.col("own") == F.col("gone"), "left_anti")
    return rows.filter("not maybe").select("row.*").unionByName(kept.select("row.*"))

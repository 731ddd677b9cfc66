"""Where queries are listed, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attrs(**values) -> F.Column:
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v.cast("string"))))


def no_lists() -> F.Column:
    return F.create_map().cast("map<string,array<string>>")


def conversation_classes(spark: SparkSession, d: str) -> DataFrame:
    """A fact is a conversation, a form a turn, its notation the role."""
    turn = F.struct(F.col("turn"), F.coalesce("text", F.lit("")).alias("text"), F.col("role").alias("notation"))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    shown = F.transform("turns", lambda t: F.struct(t["text"].alias("text"), t["notation"].alias("notation")))
    return rows.select(F.col("conv_id").cast("string").alias("fact_id"), F.lit("chat").alias("track"), shown.alias("forms"), attrs(parity=F.col("conv_id") % 2, tens=F.floor(F.col("conv_id") / 10)).alias("attrs"))


def part_classes(spark: SparkSession, d: str) -> DataFrame:
    """A fact is a part; forms: name, brand and type."""
    p = table(spark, d, "part")
    one = lambda c, n: F.struct(F.col(c).alias("text"), F.lit(n).alias("notation"))
    return p.select(F.col("p_partkey").cast("string").alias("fact_id"), F.lit("part").alias("track"), F.array(one("p_name", "name"), one("p_brand", "brand"), one("p_type", "type")).alias("forms"), attrs(size=F.col("p_size"), price=F.col("p_retailprice"), type=F.col("p_type")).alias("attrs"))


#: The same in SQL: facts with their forms, as flat rows.
CONV_SQL = """
conv as (select conv_id::varchar as fact_id, conv_id, 'chat' as track, role as notation, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn, coalesce(text, ''), role) - 1 as pos from conversations),
forms as (select fact_id || '::' || pos as form_id, * from conv)
"""
PART_SQL = """
forms as (
  select p_partkey::varchar || '::0' as form_id, p_partkey::varchar as fact_id, 0 as pos, 'name' as notation, p_name as text, p_size, p_retailprice, p_type from part
  union all select p_partkey::varchar || '::1', p_partkey::varchar, 1, 'brand', p_brand, p_size, p_retailprice, p_type from part
  union all select p_partkey::varchar || '::2', p_partkey::varchar, 2, 'type', p_type, p_size, p_retailprice, p_type from part)
"""

"""Train and test splits, membership filters and the audit of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiform.functions.text import number, shuffle_key
from lexiform.operators.classes import has_notations


def attr(name: str, attrs: str = "attrs") -> Column:
    """An attribute as text; a missing one reads ``None``."""
    return F.coalesce(F.try_element_at(F.col(attrs), F.lit(name)), F.lit("None"))


def require_attr(rows: DataFrame, name: str, attrs: str = "attrs") -> DataFrame:
    """rows, if at least one of them has the attribute; else an error."""
    if rows.filter(F.try_element_at(F.col(attrs), F.lit(name)).isNotNull()).isEmpty():
        raise ValueError(f"no row has the attribute {name}")
    return rows


def _split(test: Column) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), "test").otherwise("train").alias("split")


def by_notation(forms: DataFrame, notation: str, track: str | None = None) -> DataFrame:
    """Forms of the notation (of the track) are the test rows."""
    hit = F.col("notation") == notation
    return forms.withColumn("split", _split(hit if track is None else hit & (F.col("track") == track)))


def by_attribute(forms: DataFrame, name: str, value: str, track: str | None = None) -> DataFrame:
    hit = attr(name) == value
    return forms.withColumn("split", _split(hit if track is None else hit & (F.col("track") == track)))


def by_range(forms: DataFrame, name: str, low: float, high: float, track: str | None = None) -> DataFrame:
    """Rows whose attribute is a number in [low, high] are the test rows; none at all is an error."""
    if low > high:
        raise ValueError("low is above high")
    hit = number(F.try_element_at(F.col("attrs"), F.lit(name))).between(low, high)
    out = forms.withColumn("split", _split(hit if track is None else hit & (F.col("track") == track)))
    if out.filter("split = 'test'").isEmpty():
        raise ValueError("no row falls into the held-out range")
    return out


def shuffled(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    """df with place: 1 for the first row of a seeded shuffle of all rows.

    Ranks come from counts by the key's first four hexadecimal digits, so no task orders all rows.
    """
    keyed = df.withColumn("_key", shuffle_key(F.col(id_col), seed)).withColumn("_bucket", F.substring("_key", 1, 4))
    sizes = keyed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # 65,536 rows at most
    inside = Window.partitionBy("_bucket").orderBy("_key", F.col(id_col))
    ranked = keyed.withColumn("_in", F.row_number().over(inside)).join(F.broadcast(offsets), "_bucket")
    return ranked.withColumn("place", F.col("_before") + F.col("_in")).drop("_key", "_bucket", "_in", "_before")


def placed_in(df: DataFrame, by: list[str], id_col: str, seed: int, at: str, of: str) -> DataFrame:
    """df with two columns: the row's place from 0 in a seeded shuffle of its group (of all rows for no ``by``), and the group's size.

    Groups are numbered by parts of the key's range, as in shuffled(), so a group of any size fits.
    """
    keyed = df.withColumn("_key", shuffle_key(F.col(id_col), seed)).withColumn("_bucket", F.substring("_key", 1, 3))
    sizes = keyed.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # 4,096 rows a group at most
    before = F.coalesce(F.sum("_n").over(group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*by, "_bucket", before.alias("_before"), F.sum("_n").over(group).alias(of))
    inside = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy("_key", F.col(id_col)))
    ranked = keyed.withColumn("_in", inside).join(offsets.hint("merge") if by else F.broadcast(offsets), [*by, "_bucket"])
    return ranked.withColumn(at, F.col("_before") + F.col("_in") - 1).drop("_key", "_bucket", "_in", "_before")


def by_fact(classes: DataFrame, test_fraction: float, seed: int = 13, required: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Classes with split: whole facts go to one side; at least one to either. Only classes with all required notations take part."""
    held = classes.filter(has_notations("forms", required)) if required else classes
    held = shuffled(held.dropDuplicates(["fact_id"]), "fact_id", seed)
    if limit is not None:
        held = held.filter(F.col("place") <= limit)
    total = held.agg(F.count("*").alias("_total"))
    cut = F.greatest(F.lit(1), F.least(F.floor(F.col("_total") * test_fraction), F.col("_total") - 1))
    return held.join(F.broadcast(total)).withColumn("split", _split(F.col("place") <= cut)).drop("_total", "place")


def by_row(rows: DataFrame, id_col: str, valid_fraction: float, seed: int = 13) -> DataFrame:
    """Rows with split: the first max(1, int(n * fraction)) of a shuffle are ``valid``, the others ``train``."""
    placed = shuffled(rows, id_col, seed)
    total = placed.agg(F.count("*").alias("_total"))
    cut = F.greatest(F.lit(1), F.floor(F.col("_total") * valid_fraction))
    return placed.join(F.broadcast(total)).withColumn("split", F.when(F.col("place") <= cut, "valid").otherwise("train")).drop("_total", "place")


def counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split").agg(F.count("*").alias("n"))


def keep_facts(rows: DataFrame, reference: DataFrame, reference_split: str | None = None, exclude: bool = False) -> DataFrame:
    """Rows whose fact_id occurs (exclude: does not occur) in the reference, of one of its splits if that is named."""
    held = reference if reference_split is None else reference.filter(F.col("split") == reference_split)
    return rows.join(held.select("fact_id").distinct(), "fact_id", "left_anti" if exclude else "left_semi")


def audit(train: DataFrame, test: DataFrame, test_split: str | None = None, heldout: str | None = None) -> DataFrame:
    """(finding, n): shared facts, and whether the held-out notation is absent from train and present in test. All n are 0 for a clean pair."""
    tested = test if test_split is None else test.filter(F.col("split") == test_split)
    shared = train.select("fact_id").distinct().join(tested.select("fact_id").distinct(), "fact_id", "left_semi")
    out = shared.agg(F.lit("shared_facts").alias("finding"), F.count("*").alias("n"))
    if heldout is not None:
        used = train.filter(F.col("notation") == heldout).agg(F.lit("heldout_in_train").alias("finding"), F.count("*").alias("n"))
        missing = tested.filter(F.col("notation") == heldout).agg(F.lit("heldout_missing_in_test").alias("finding"), F.when(F.count("*") == 0, 1).otherwise(0).cast("bigint").alias("n"))
        out = out.unionByName(used).unionByName(missing)
    return out

"""Labelled rows for fitting a classifier, and features gathered on the driver within a bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiform.llm.common import held_out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, columns: list[str], id_col: str = "doc_id") -> DataFrame:
    """About ``bound`` labelled rows at most, chosen by a hash of the id: label and columns of docs.

    Held-out rows and labels that are not 0 or 1 are left out; of conflicting labels of one id 1 counts;
    rows of docs that repeat an id are all taken; other columns of either table, whatever their names, do
    not matter. The sampled labels, not the documents, are broadcast: their number is bounded.
    """
    usable = labels.select(F.col(id_col).cast("long").alias("l_id"), F.col(label).cast("int").alias("label"))
    usable = usable.filter(F.col("label").isin(0, 1) & F.col("l_id").isNotNull() & ~held_out(F.col("l_id")))
    share = min(1.0, bound / max(1, usable.count()))
    picked = usable.filter(F.pmod(F.xxhash64("l_id", F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20))).groupBy("l_id").agg(F.max("label").alias("label"))
    # Only named columns of docs take part, under names of their own.
    rows = docs.select(F.col(id_col).cast("long").alias("d_id"), *(F.col(f"`{c}`").alias(f"d_{i}") for i, c in enumerate(columns)))
    joined = rows.join(F.broadcast(picked), rows.d_id == picked.l_id)
    return joined.select(F.col("l_id").alias("doc_id"), "label", *(F.col(f"d_{i}").alias(c) for i, c in enumerate(columns)))

"""A quoted table read in parallel, from Spark's own splits of text files.

A line break inside a quoted field does not end a record, and a split cannot tell from its own
bytes whether it starts inside one. The number of quotes in the splits before it can: one pass counts quotes by split, a
running sum over the splits (a row each) gives the state at each start. In a second pass every split puts its lines together to
records; only the two pieces at its edges that belong to records of other splits are joined afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What a piece is: a whole record, the rest of one that an earlier split began, the start of one that does not end here.
WHOLE, REST, OPEN = 0, 1, 2


def _pieces(batches: Iterator) -> Iterator:
    """(file, split, seq, kind, record) from lines (file, split, inside, value), which come in order."""
    import pyarrow as pa

    at, seq, held, kind = None, 0, [], WHOLE
    out: dict[str, list] = {}

    def put(record_kind: int) -> None:
        nonlocal seq
        for name, v in zip(("file", "split", "seq", "kind", "record"), (*at, seq, record_kind, "\n".join(held)), strict=True):
            out.setdefault(name, []).append(v)
        seq += 1
        held.clear()

    def sent():
        kinds = {"file": pa.string(), "split": pa.int64(), "seq": pa.int64(), "kind": pa.int32(), "record": pa.string()}
        batch = pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in kinds.items()], list(kinds))
        out.clear()
        return batch

    odd = False
    for batch in batches:
        for file, split, inside, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != (file, split):
                if held:  # the split before ended inside a record
                    put(OPEN if kind == WHOLE else REST)
                at, seq, odd = (file, split), 0, bool(inside)
                kind = REST if odd else WHOLE
            held.append(value)
            odd ^= value.count('"') % 2 == 1
            if not odd:
                put(kind)
                kind = WHOLE
        if out:
            yield sent()
    if held:
        put(OPEN if kind == WHOLE else REST)
        yield sent()


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """(ord, record): the records of quoted text files, with line breaks inside quotes. ord: file, then split and place in it (in one number)."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    by_split = lines.groupBy("file", "start").agg(F.sum(quotes).alias("quotes"))
    w = Window.partitionBy("file").orderBy("start")  # a row a split
    before = F.coalesce(F.sum("quotes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = by_split.select("file", "start", (before % 2).alias("inside"), (F.row_number().over(w) - 1).cast("long").alias("split"))
    rows = lines.join(F.broadcast(splits), ["file", "start"]).select("file", "split", "inside", "value")
    pieces = rows.mapInArrow(_pieces, "file string, split long, seq long, kind int, record string")
    place = F.struct(F.col("file"), (F.shiftleft("split", 33) + F.col("seq")).alias("row")).alias("ord")
    whole = pieces.filter(F.col("kind") == WHOLE).select(place, "record")
    # Two pieces a split at most. An open record takes the pieces behind it, up to the next open one.
    order = ["split", "seq"]
    chain = F.sum((F.col("kind") == OPEN).cast("int")).over(Window.partitionBy("file").orderBy(*order))
    edges = pieces.filter(F.col("kind") != WHOLE).withColumn("chain", chain).groupBy("file", "chain").agg(F.min(F.struct(*order)).alias("first"), F.array_sort(F.collect_list(F.struct(*order, "record"))).alias("parts"))
    edges = edges.select("file", "first.*", F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"))
    return whole.unionByName(edges.select(place, "record"))


def read_quoted(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated quoted table with a header, all columns text, and ord."""
    options = {"sep": "\t", "quote": '"', "escape": '"'}
    columns = spark.read.options(header=True, multiLine=True, **options).csv(path).columns  # the first record
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = quoted_records(spark, path).filter((F.col("ord.row") > 0) & (F.col("record") != ""))
    return rows.select("ord", F.from_csv("record", schema, options).alias("r")).select("r.*", "ord")

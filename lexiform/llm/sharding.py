"""Balanced label propagation: linked documents move to common shards under quotas.

Rows with the same link key (equal texts, or any class id) are neighbours. Rows
that agree in key, chunk and shard have the same neighbours, so they move as one
cell; a round joins the cells with their key's votes, lets each cell pick the
open shard that holds most of its key, if that is more than its own holds, and admits
cells in hash order while the shard has quota left. A key may hold a third of all rows: it is divided into chunks of
about CHUNK rows, which follow each other from shard to shard as these fill.
Unlinked rows stay where their hash puts them and fill up the shards at the end.

The law is ``rows``: shard counts are at most one apart, slots are gapless from 0.
Ranks inside shards come from counts by (shard, bucket) - a table of fixed size -
and a window inside each bucket, so no task ever holds a shard.

Defined cases: null text has no bytes and links with empty text; rows that repeat
id and text are placed one by one; null ids are placed like others; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiform.llm.common import materialize

N_SHARDS, ROUNDS, CHUNK, ADMIT, BUCKETS, LINKED, SALTS = 16, 8, 4096, 256, 4096, 1024, 16


def vertices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, crc, key, copy, h): a row for each row of docs, without its text."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("crc"), F.unhex(F.sha2(text, 256)).alias("key"))
    rows = rows.groupBy("doc_id", "size", "crc", "key").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies")
    return rows.withColumn("h", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "key", "copy"))


def propagate(cells: DataFrame, capacity: list[int], rounds: int = ROUNDS) -> DataFrame:
    """cells (key, chunk, home, n) with the shard that each ends in; no shard gets more than its capacity from moves."""
    cells = materialize(cells.withColumn("shard", F.col("home")), "cells")
    for turn in range(rounds):
        load = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row a shard
        quota = [c - load.get(s, 0) for s, c in enumerate(capacity)]
        is_open = F.element_at(F.array(*(F.lit(q > 0) for q in quota)), F.col("shard") + 1)
        votes = cells.groupBy("key", "shard").agg(F.struct(F.sum("n").alias("n"), F.xxhash64("key", "shard").alias("tie")).alias("votes"))
        best = votes.filter(is_open).groupBy("key").agg(F.max("votes").alias("most"), F.max_by("shard", "votes").alias("target"))
        # A cell moves only to a shard with more of its neighbours than its own has.
        pick = votes.join(best, "key").filter(F.col("most") > F.col("votes")).select("key", "shard", "target")
        wish = cells.join(pick, ["key", "shard"], "left").withColumn("at", F.pmod(F.xxhash64("key", "chunk", "shard", F.lit(turn)), F.lit(ADMIT)).cast("int"))
        wish = materialize(wish.withColumn("moves", F.col("target").isNotNull()), f"wish{turn}")
        demand = wish.filter("moves").groupBy("target", "at").agg(F.sum("n").alias("n")).collect()  # shards x ADMIT rows at most
        if not demand:
            return wish.select("key", "chunk", "home", "n", "shard")
        cut, used = [0] * len(capacity), [0] * len(capacity)
        for target in range(len(capacity)):
            for at, n in sorted((r["at"], r["n"]) for r in demand if r["target"] == target):
                if used[target] + n > quota[target]:
                    break
                used[target], cut[target] = used[target] + n, at + 1
        admitted = F.col("moves") & (F.col("at") < F.element_at(F.array(*map(F.lit, cut)), F.col("target") + 1))
        cells = wish.select("key", "chunk", "home", "n", F.when(admitted, F.col("target")).otherwise(F.col("shard")).alias("shard"))
        cells = materialize(cells.groupBy("key", "chunk", "home", "shard").agg(F.sum("n").alias("n")).select("key", "chunk", "home", "n", "shard"), f"cells{turn}")
    return cells


def even_slots(placed: DataFrame, total: int, n_shards: int) -> DataFrame:
    """placed (…, shard, bucket, h): surplus rows of full shards go to those below their target; adds slot."""
    by_bucket = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(by_bucket.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))), "offsets")  # shards x BUCKETS rows at most
    load = {r["shard"]: r["n"] for r in offsets.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    loads = [load.get(s, 0) for s in range(n_shards)]
    target = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    surplus_from, base = [], 0
    for have, want in zip(loads, target, strict=True):
        surplus_from.append(base)
        base += max(0, have - want)
    row = Window.partitionBy("shard", "bucket").orderBy("group", "h", "doc_id", "copy")
    ranked = placed.join(F.broadcast(offsets.select("shard", "bucket", "offset")), ["shard", "bucket"]).withColumn("rank", F.col("offset") + F.row_number().over(row) - 1)
    at = lambda values: F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), F.col("shard") + 1)
    over = ranked.withColumn("spare", F.when(F.col("rank") >= at(target), at(surplus_from) + F.col("rank") - at(target)))
    new_shard, new_slot, base = F.col("shard"), F.col("rank"), 0
    for s, (have, want) in enumerate(zip(loads, target, strict=True)):
        if have < want:
            here = (F.col("spare") >= base) & (F.col("spare") < base + want - have)
            new_shard, new_slot = F.when(here, F.lit(s)).otherwise(new_shard), F.when(here, F.col("spare") - base + have).otherwise(new_slot)
            base += want - have
    return over.withColumn("new_shard", new_shard.cast("int")).withColumn("slot", new_slot.cast("long")).drop("shard").withColumnRenamed("new_shard", "shard")


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, linked (whether another row has the same text), link_id (equal for linked rows)."""
    rows = materialize(vertices(docs, id_col, text_col).withColumn("home", F.pmod("h", F.lit(n_shards)).cast("int")), "vertices")
    total = rows.count()
    target = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    chunks = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("group") / CHUNK))
    groups = rows.groupBy("key").agg(F.count("*").alias("group")).filter("group > 1")
    # A group may hold a third of all rows: its rows are dealt over SALTS tasks.
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    tagged = rows.withColumn("salt", F.pmod(F.xxhash64("h"), F.lit(SALTS)).cast("int")).join(groups, ["key", "salt"], "left").withColumn("chunk", F.when(F.col("group") > 1, F.pmod(F.xxhash64("h"), chunks)))
    tagged = materialize(tagged, "tagged")
    linked = tagged.filter("group > 1")
    cells = propagate(linked.groupBy("key", "chunk", "home").agg(F.count("*").alias("n")), target, rounds)
    moved = linked.join(cells.select("key", "chunk", "home", "shard"), ["key", "chunk", "home"])
    bucket = F.pmod(F.xxhash64("key", "chunk"), F.lit(LINKED))
    placed = moved.select("doc_id", "size", "crc", "copy", "h", "shard", bucket.cast("int").alias("bucket"), F.xxhash64("key", "chunk").alias("group"), F.xxhash64("key").alias("link_id"), F.lit(True).alias("linked"))
    alone = tagged.filter("group is null").select("doc_id", "size", "crc", "copy", "h", F.col("home").alias("shard"), (F.lit(LINKED) + F.pmod(F.xxhash64("h"), F.lit(BUCKETS - LINKED))).cast("int").alias("bucket"), F.lit(0).cast("long").alias("group"), F.lit(0).cast("long").alias("link_id"), F.lit(False).alias("linked"))
    placed = materialize(placed.unionByName(alone), "placed")
    out = even_slots(placed, total, n_shards)
    return out.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "linked", F.when(F.col("linked"), F.col("link_id")).alias("link_id"))


def cut_edges(sharded: DataFrame) -> DataFrame:
    """One row: links between linked rows, and those whose ends are in different shards. From counts by (link_id, shard): no pairs are made."""
    parts = sharded.filter("linked").groupBy("link_id", "shard").agg(F.count("*").alias("n"))
    links = parts.groupBy("link_id").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("inside"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return links.agg(zero(F.sum(F.expr("n * (n - 1) div 2"))).alias("links"), zero(F.sum(F.expr("(n * n - inside) div 2"))).alias("cut"))

"""Exact de-duplication in two passes over a Bloom filter of repeated hashes.

Pass 1 marks, for each of ``HASHES`` hash functions, the slots that more than
one row sets; two equal texts set the same slots, so every repeated text has
all its slots marked. No row is shuffled for it: each task sends what it has
seen once and twice as containers of CONTAINER slots, a container being a list of
16-bit places or, where that is larger, a bitmap; containers of one place in the filter
are merged one after the other. Pass 2 tests each row against the marked slots: rows
with an unmarked slot are unique and pass straight through, only the others
shuffle - as (hash, doc_id), never with their text - and are compared exactly.

The filter has about SLOTS_PER_ROW slots a row. It is divided by hash range so that
no part has over MAX_SLOTS (one bit each, 64 MB): parts are broadcast one after the
other, each to the hashes of its range alone, so the share of unique rows that
pass straight through stays the same at any number of rows.

Defined cases: null text counts as empty; of equal texts the largest doc_id
stays; rows that repeat both text and doc_id keep one row; a null doc_id loses
to any other and stays if all are null; an empty table gives no rows; texts of any
length are hashed whole; other columns, whatever their names, are kept by
``drop_copies`` and ignored by ``duplicate_groups``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiform.llm.common import discard, join_stats, materialize

SLOTS_PER_ROW, MAX_SLOTS, MIN_SLOTS, HASHES = 16, 1 << 29, 1 << 16, 2
#: Slots of a container; a task sends what it has seen after so many slots.
CONTAINER, SENT_AT = 1 << 16, 1 << 22
BITMAPS = "part int, bucket int, bits array<bigint>"


def text_hash(text) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def shape(n_rows: int) -> tuple[int, int]:
    """(parts, slots of a part), both powers of two."""
    slots = max(MIN_SLOTS, 1 << max(0, n_rows * SLOTS_PER_ROW - 1).bit_length())
    return max(1, slots // MAX_SLOTS), min(slots, MAX_SLOTS)


def _part(sha, parts: int) -> Column:
    """The range of a hash."""
    return F.pmod(F.xxhash64(sha, F.lit("part")), F.lit(parts)).cast("int")


def _slots(sha, n_slots: int) -> list[Column]:
    return [F.xxhash64(sha, F.lit(i)).bitwiseAND(F.lit(n_slots - 1)) for i in range(HASHES)]


def pack(places: np.ndarray) -> bytes:
    """Sorted places of a container: 16 bits each, or a bitmap if that is smaller."""
    if len(places) * 2 < CONTAINER // 8:
        return places.astype("<u2").tobytes()
    bits = np.zeros(CONTAINER, bool)
    bits[places] = True
    return np.packbits(bits, bitorder="little").tobytes()


def unpack(raw: bytes) -> np.ndarray:
    """The container as one flag a slot."""
    if len(raw) == CONTAINER // 8:
        return np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little").astype(bool)
    bits = np.zeros(CONTAINER, bool)
    bits[np.frombuffer(raw, "<u2")] = True
    return bits


def seen(batches: Iterator) -> Iterator:
    """Of (part, slot, …) rows: containers of the slots that this task has seen once or more, and twice or more."""
    import pyarrow as pa

    def containers(held: list[np.ndarray]) -> pa.RecordBatch:
        slots = np.sort(np.concatenate([*held, np.zeros(0, np.int64)]))
        first = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]])) if len(slots) else np.zeros(0, np.int64)
        more, slots = np.diff(np.append(first, len(slots))) > 1, slots[first]
        cuts = np.flatnonzero(np.concatenate([[True], slots[1:] // CONTAINER != slots[:-1] // CONTAINER])) if len(slots) else first
        spans = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(slots)], strict=True)) if len(slots) else []
        places = slots % CONTAINER
        once, twice = [pack(places[a:b]) for a, b in spans], [pack(places[a:b][more[a:b]]) for a, b in spans]
        at = slots[cuts] // CONTAINER
        return pa.RecordBatch.from_arrays([pa.array((at >> 32).astype(np.int32)), pa.array((at & 0xFFFFFFFF).astype(np.int32)), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], ["part", "bucket", "once", "twice"])

    held, n = [], 0
    for batch in batches:
        part = batch.column(0).to_numpy().astype(np.int64) << 48  # 32 bits of containers, 16 of places
        for i in range(HASHES):
            held.append(part | batch.column(1 + i).to_numpy())
            n += len(part)
        if n >= SENT_AT:
            yield containers(held)
            held, n = [], 0
    yield containers(held)


def merged(batches: Iterator) -> Iterator:
    """Of containers in order of their place: the slots that two rows or more set. One place is held at a time."""
    import pyarrow as pa

    def done(at: tuple[int, int], twice: np.ndarray) -> pa.RecordBatch:
        words = np.packbits(twice, bitorder="little").view("<i8")
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([words], pa.list_(pa.int64()))], ["part", "bucket", "bits"])

    at, once, twice = None, None, None
    for batch in batches:
        for part, bucket, o, t in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if at != (part, bucket):
                if at and twice.any():
                    yield done(at, twice)
                at, once, twice = (part, bucket), np.zeros(CONTAINER, bool), np.zeros(CONTAINER, bool)
            new = unpack(o)
            twice |= unpack(t) | (once & new)
            once |= new
    if at and twice.any():
        yield done(at, twice)


def repeated_slots(hashes: DataFrame, parts: int, n_slots: int) -> DataFrame:
    """(part, bucket, bits): the slots that at least two rows set, CONTAINER a row, as 64-bit words."""
    slots = hashes.select(_part(F.col("sha"), parts).alias("part"), *(c.alias(f"slot{i}") for i, c in enumerate(_slots(F.col("sha"), n_slots))))
    sent = slots.mapInArrow(seen, "part int, bucket int, once binary, twice binary")
    return sent.repartition("part", "bucket").sortWithinPartitions("part", "bucket").mapInArrow(merged, BITMAPS)


def _marked(rows: DataFrame, bitmaps: DataFrame, n_slots: int) -> DataFrame:
    """rows with ``maybe``: whether all their slots are marked. bitmaps: (bucket, bits) of one part, MAX_SLOTS / 8 bytes at most, broadcast once."""
    flags, held = [], F.broadcast(bitmaps)
    for i, slot in enumerate(_slots(F.col("sha"), n_slots)):
        own = held.select(F.col("bucket").alias(f"bucket{i}"), F.col("bits").alias(f"bits{i}"))
        rows = rows.withColumn(f"slot{i}", slot).withColumn(f"bucket{i}", F.expr(f"cast(slot{i} div {CONTAINER} as int)")).join(own, f"bucket{i}", "left")
        flags.append(f"coalesce(getbit(bits{i}[cast(slot{i} % {CONTAINER} div 64 as int)], cast(slot{i} % 64 as int)) = 1, false)")
    rows = rows.withColumn("maybe", F.expr(" and ".join(flags)))
    return rows.drop(*(f"{c}{i}" for i in range(HASHES) for c in ("slot", "bucket", "bits")))


def tested(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, sha, maybe) of every row: false where its hash is known to be unique."""
    parts, n_slots = shape(docs.count())
    hashes = docs.select(F.col(id_col).alias("doc_id"), text_hash(F.col(text_col)).alias("sha"))
    # Written by range: each pass of a part reads its own hashes alone.
    hashes = materialize(hashes.withColumn("part", _part(F.col("sha"), parts)), "hashes", ["part"])
    bitmaps = materialize(repeated_slots(hashes, parts, n_slots), "bitmaps")
    out = None
    for part in range(parts):
        rows = _marked(hashes.filter(F.col("part") == part).drop("part"), bitmaps.filter(F.col("part") == part).select("bucket", "bits"), n_slots)
        rows = materialize(rows, "marked")
        out = rows if out is None else out.unionByName(rows)
    discard(hashes)
    discard(bitmaps)
    return out


def _groups(maybe: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (doc_id, sha): the distinct rows with their copies, and a row for each hash; both with partial sums."""
    ids = materialize(maybe.groupBy("sha", "doc_id").agg(F.count("*").alias("copies")), "copies")
    groups = ids.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"), F.count("*").alias("ids"))
    return ids, materialize(groups, "groups")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = tested(docs, id_col, text_col)
    ids, groups = _groups(rows.filter("maybe").select("doc_id", "sha"))
    copies = (
        join_stats(ids, groups, "sha", "ids")  # a group may hold a third of all rows
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "sha")
    )
    alone = rows.filter(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    return alone.unionByName(copies).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the copies: all columns, the row with the largest id of each text.

    Rows are tested against a filter of the hashes that do repeat; those that pass it have no copy and do not shuffle.
    """
    _, groups = _groups(tested(docs, id_col, text_col).filter("maybe").select("doc_id", "sha"))
    repeated = materialize(groups.filter("group_size > 1").select("sha", "keep_id", "ids"), "repeated")
    n_slots = min(MAX_SLOTS, shape(repeated.count())[1])
    slots = F.explode(F.array(*_slots(F.col("sha"), n_slots)))
    words = repeated.select(slots.alias("slot")).groupBy(F.expr(f"cast(slot div {CONTAINER} as int)").alias("bucket"), F.expr(f"cast(slot % {CONTAINER} div 64 as int)").alias("word"))
    words = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits"))
    held = F.map_from_entries(F.collect_list(F.struct("word", "bits")))  # CONTAINER / 64 words at most
    zeros = F.transform(F.sequence(F.lit(0), F.lit(CONTAINER // 64 - 1)), lambda w: F.coalesce(F.try_element_at(F.col("held"), w), F.lit(0).cast("bigint")))
    bitmaps = materialize(words.groupBy("bucket").agg(held.alias("held")).select("bucket", zeros.alias("bits")), "bitmaps")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("doc_id"), text_hash(F.col(text_col)).alias("sha"))
    marked = _marked(rows, bitmaps, n_slots)
    known = repeated.select("sha", F.col("keep_id"), F.lit(True).alias("copied"))
    again = marked.filter("maybe").join(known, "sha", "left")
    alone = again.filter("copied is null").select("row.*")
    stays = again.filter(F.col("copied") & F.col("doc_id").eqNullSafe(F.col("keep_id")))
    # Rows that repeat both text and id: one of each stays.
    once = stays.groupBy("sha", "doc_id").agg(F.first("row").alias("row"))
    return marked.filter(~F.col("maybe")).select("row.*").unionByName(alone).unionByName(once.select("row.*"))

"""Which filters of a chain do the work: a packed bitmap index over filters, labels and parts.

Every document becomes one bit in a plane for each filter that it fails and for each
label. A part's documents stand together, from a word's edge on, so that a part is a
range of words. For each of the 32 sets of filters that can be a prefix of an order,
AND-NOT leaves the documents that pass all of them, and popcounts by part give how many
there are, how many of them are good and how many toxic. Partitions send these counts
only; all figures of all 120 orders follow from their sums:

* kept: documents that pass the prefix with the step's filter
* removed: what the step's filter takes from those that pass the prefix before it
* redundant: the rest of what fails the filter
* unique_fails: documents that fail this filter alone
* good_lost, toxic_lost: labelled documents among the removed
* shapley: the filter's removed documents, summed over all orders

Filters over words (maximal runs without white space), case-sensitive: A under 200 words, B fewer
than half of the words distinct, C over 2 % capitals of A-Z among the code points, D any of
``#$%&*|``, E a text that a smaller doc_id has too.

Defined cases: null and empty texts are the empty text (they fail A, and E if a smaller id has it);
a null source is the part ''; rows with a null doc_id never fail E and have no labels; rows that repeat
an id count one by one and are not copies of each other; of several labels of an id each
counts; texts of any length are read whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiform.llm.common import discard, join_stats, materialize

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
SETS = 1 << len(FILTERS)
WORD_ENDS = r"[\x20\x09-\x0D]+"
#: A task holds the counts of so many parts before it sends them on.
HELD_PARTS = 4096
PLANES = ["n", "good", "toxic"]


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, part, fails, sha): bits of the filters A to D that a whole text fails, and its digest. One pass, no shuffle."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", WORD_ENDS), ""))
    n, length = F.size("words"), F.length("text")
    fails = [
        n < 200,
        100 * F.size(F.array_distinct("words")) < 50 * n,
        100 * F.length(F.regexp_replace("text", "[^A-Z]+", "")) > 2 * length,
        F.col("text").rlike(r"[#$%&*|]"),
    ]
    bits = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    return rows.select("doc_id", "part", bits.alias("fails"), F.substring(F.unhex(F.sha2("text", 256)), 1, 16).alias("sha"))


def with_copies(rows: DataFrame) -> DataFrame:
    """rows with the bit of filter E where a smaller doc_id has the same text. Texts that many rows share meet nowhere as a group."""
    groups = materialize(rows.groupBy("sha").agg(F.min("doc_id").alias("least"), F.count("*").alias("times")), "audit-texts")
    copied = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return join_stats(rows, groups, "sha", "times").select("doc_id", "part", (F.col("fails") + F.when(copied, 16).otherwise(0)).alias("fails"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with good (quality is 1) and toxic (toxic is 1)."""
    is_one = lambda c: F.coalesce(F.max(F.col(c).cast("int") == 1), F.lit(False))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    named = rows.filter("doc_id is not null").join(marks, F.col("doc_id") == F.col("l_id"), "left")
    told = named.select("part", "fails", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    return told.unionByName(rows.filter("doc_id is null").select("part", "fails", F.lit(False).alias("good"), F.lit(False).alias("toxic")))


class Bitmap:
    """Packed planes over some documents; those of part i are the words from start[i] on."""

    def __init__(self, part: np.ndarray, n_parts: int, fails: np.ndarray, good: np.ndarray, toxic: np.ndarray):
        sizes = np.bincount(part, minlength=n_parts)
        words = -(-sizes // 64)
        self.start = np.concatenate([[0], np.cumsum(words)[:-1]])
        order = np.argsort(part, kind="stable")
        inside = np.arange(len(part)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self._slot = self.start[part[order]] * 64 + inside
        self._order, self._bits = order, int(words.sum()) * 64
        self.there = self._plane(np.ones(len(part), bool))
        self.labels = [self._plane(good), self._plane(toxic)]
        self.fails = [self._plane(fails >> i & 1) for i in range(len(FILTERS))]

    def _plane(self, flags: np.ndarray) -> np.ndarray:
        bits = np.zeros(self._bits, np.uint8)
        bits[self._slot] = flags[self._order]
        return np.packbits(bits, bitorder="little").view(np.uint64)

    def counts(self) -> np.ndarray:
        """[part, set, plane]: documents, good ones and toxic ones that pass every filter of the set."""
        alive, out = [self.there], np.zeros((len(self.start), SETS, len(PLANES)), np.int64)
        for held in range(SETS):
            if held:
                low = (held & -held).bit_length() - 1
                alive.append(alive[held & (held - 1)] & ~self.fails[low])
            for k, plane in enumerate((alive[held], *(alive[held] & own for own in self.labels))):
                out[:, held, k] = np.add.reduceat(np.bitwise_count(plane).astype(np.int64), self.start)
        return out


def _counted(batches: Iterator) -> Iterator:
    """(part, held, n, good, toxic): counts of a partition's bitmaps by part and set of filters."""
    import pyarrow as pa

    names: dict[str, int] = {}
    total = np.zeros((0, SETS, len(PLANES)), np.int64)

    def sent():
        parts = pa.array(list(names), pa.string()).take(pa.array(np.repeat(np.arange(len(names)), SETS)))
        held = pa.array(np.tile(np.arange(SETS, dtype=np.int32), len(names)))
        return pa.RecordBatch.from_arrays([parts, held, *(pa.array(total[: len(names), :, k].ravel()) for k in range(len(PLANES)))], ["part", "held", *PLANES])

    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column(0).dictionary_encode()
        flags = [batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3)]
        found = Bitmap(part.indices.to_numpy(), len(part.dictionary), *flags).counts()
        at = np.array([names.setdefault(name, len(names)) for name in part.dictionary.to_pylist()])
        if len(total) < len(names):
            total = np.concatenate([total, np.zeros((2 * len(names) - len(total), SETS, len(PLANES)), np.int64)])
        total[at] += found
        if len(names) >= HELD_PARTS:
            yield sent()
            names, total = {}, total[:0]
    if names:
        yield sent()


def prefix_counts(rows: DataFrame) -> DataFrame:
    """(part, held, n, good, toxic) summed over all partitions. rows: part, fails, good, toxic."""
    sent = rows.select("part", "fails", "good", "toxic").mapInArrow(_counted, "part string, held int, n long, good long, toxic long")
    return sent.groupBy("part", "held").agg(*(F.sum(c).alias(c) for c in PLANES))


def interactions(counts: DataFrame) -> DataFrame:
    """A row for each part, order and step, from the counts of the 32 sets of filters."""
    one = counts.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("held", *PLANES))).alias("c"))  # 32 entries a part
    full = SETS - 1
    n = lambda held: F.get("c", held if isinstance(held, Column) else F.lit(held))["n"]

    def shapley(bit: int) -> Column:
        weights = {held: factorial(held.bit_count()) * factorial(len(FILTERS) - 1 - held.bit_count()) for held in range(SETS) if not held & bit}
        return sum((w * (n(held) - n(held | bit)) for held, w in weights.items()), F.lit(0).cast("bigint"))

    bits = [1 << i for i in range(len(FILTERS))]
    each = F.array(*(F.struct((n(0) - n(b)).alias("fails"), (n(full - b) - n(full)).alias("unique_fails"), shapley(b).alias("shapley")) for b in bits))
    rows = one.withColumn("own", each).withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    before = " + ".join(f"if(instr(substring(filter_order, 1, step - 1), '{f}') > 0, {1 << i}, 0)" for i, f in enumerate(FILTERS))
    rows = rows.withColumn("at", F.expr(f"instr('{FILTERS}', substring(filter_order, step, 1)) - 1")).withColumn("before", F.expr(before))
    rows = rows.withColumn("after", F.expr("before + shiftleft(1, at)"))
    rows = rows.select("part", "filter_order", "step", F.get("c", F.col("before")).alias("x"), F.get("c", F.col("after")).alias("y"), F.get("own", F.col("at")).alias("own"))
    removed = F.col("x.n") - F.col("y.n")
    return rows.select(
        "part", "filter_order", "step", F.col("y.n").alias("kept"), removed.alias("removed"), (F.col("own.fails") - removed).alias("redundant"), F.col("own.unique_fails").alias("unique_fails"),
        (F.col("x.good") - F.col("y.good")).alias("good_lost"), (F.col("x.toxic") - F.col("y.toxic")).alias("toxic_lost"), F.col("own.shapley").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of the five filters."""
    rows = materialize(features(docs), "audit-features")
    counts = materialize(prefix_counts(with_labels(with_copies(rows), labels)), "audit-counts")
    discard(rows)
    return interactions(counts)

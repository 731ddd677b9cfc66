"""N-gram Jaccard join by T-occurrence search, and the components of its links.

A document is the set of its distinct shingles of ``words`` words (64-bit hashes);
documents link at a Jaccard similarity of ``percent`` / 100 or more. Equal sets are one set
from the start (named by a 128-bit digest). All shingles stand in one order: unique ones first, then those that
repeat, then those not counted, then frequent ones by frequency. Sets that link
share at least K of their first n - ceil(n * percent / 100) + K shingles, so only
these are indexed, and of them only those that are not known to be unique; sets
whose first shingles are all unique link with nothing.

* Long lists join the sets that share them into clusters. All members of a cluster
  search all others, in pairs of tiles of TILE sets: DivideSkip merges the short
  lists of a tile's index by a heap and probes the long ones. Tiles return the number of links
  and the components of their sets, not the links.
* Short inverted lists (up to SHORT sets) are merged: pairs of sets of different
  clusters that occur in the required number of lists are candidates, all verified
  by binary probes of the full sets.

No list, cluster or group of copies is ever gathered in one task, and no case is
dropped: what the order does not thin out is searched in tiles. The pairs inside a
cluster are searched even if they share a component, so work grows with the square
of a cluster's distinct sets.

Defined cases: words are runs of bytes other than white space, A-Z lower-cased; with
fewer than ``words`` words the whole sequence is the one shingle; null texts, empty texts and
those without words have empty sets and link with nothing; rows may repeat; a null
id is ignored by the minimum; texts are read whole; an empty table gives no
rows; other columns are ignored (kept by ``drop_near_copies``).
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiform.llm.common import discard, drop_ids, join_stats, materialize, small_batches
from lexiform.llm.wordhash import SPACES, Block, blocks, mix

WORDS, PERCENT, K, SHORT, TILE, HEAP = 4, 85, 3, 32, 2048, 256
TILE_SHINGLES = 1 << 21
#: Share of the hash range in which shingles are counted; sets up to SMALL are counted whole.
ZONE, SMALL = 0.4, 64
#: The bitmap of repeated shingles has about two bits for each expected shingle of the zone, up to MAX_BITS (256 MB).
#: Beyond that it thins out less: more sets are indexed, results stay the same.
MAX_BITS, MAX_HOT, BUCKET_SHINGLES, BYTES_A_WORD = 1 << 31, 1 << 20, 1 << 21, 6
_FACTORS = np.random.default_rng(11).integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
_TOP = np.uint64(int(ZONE * (1 << 64)))


def shingle_sets(block: Block, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    starts, ends, first = block.words(SPACES)
    h = block.hashes(starts, ends)
    n = max(0, len(h) - words + 1)
    rolled = np.zeros(n, np.uint64)
    for j in range(words):
        rolled += h[j : j + n] * _FACTORS[j]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            out.append(mix(np.array([(h[a:b] * _FACTORS[8 : 8 + b - a]).sum() + np.uint64(b - a)], np.uint64)))
        else:
            out.append(rolled[:0])
    return out


def needed(n: int, percent: int = PERCENT) -> int:
    """Least overlap of a set of n with any set that it links with."""
    return -(-n * percent // 100)


def linked(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """Binary probes of the larger set by the smaller one."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or len(x) * 100 < len(y) * percent:
        return False
    at = np.searchsorted(y, x)
    overlap = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return overlap * 100 >= percent * (len(x) + len(y) - overlap)


def merge_short(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct members of some sorted lists and in how many lists each occurs.

    Up to HEAP entries pass a heap of list heads; more are merged as sorted runs, which is what a stable sort does.
    """
    if sum(map(len, lists)) <= HEAP:
        found = [(member, sum(1 for _ in same)) for member, same in groupby(heapq.merge(*(x.tolist() for x in lists)))]
        both = np.array(found, np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]
    merged = np.sort(np.concatenate(lists), kind="stable")
    first = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1]]))
    return merged[first], np.diff(np.append(first, len(merged)))


def matches(queries: list[np.ndarray], sets: list[np.ndarray], percent: int = PERCENT) -> Iterator[tuple[int, np.ndarray]]:
    """(query, sets that link with it) by DivideSkip.

    A set that links occurs in T lists of the query at least. Its T - 1 longest lists are set apart: what links
    occurs in one of the others, so these are merged by a heap; members that can still reach their overlap are kept
    and probe the long lists by binary search.
    """
    if not queries or not sets:
        return
    shingles = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(shingles, kind="stable")  # members of a list stand in order
    shingles, owner, size = shingles[order], owner[order], np.array([len(s) for s in sets])
    for q, query in enumerate(queries):
        if not len(query):
            continue
        lo, hi = np.searchsorted(shingles, query, "left"), np.searchsorted(shingles, query, "right")
        by_length = np.argsort(lo - hi, kind="stable")
        apart = max(1, needed(len(query), percent)) - 1
        long, short = by_length[:apart], by_length[apart:]
        found, times = merge_short([owner[lo[i] : hi[i]] for i in short if hi[i] > lo[i]] or [owner[:0]])
        n = size[found]
        fits = (n * 100 >= percent * len(query)) & (len(query) * 100 >= percent * n) & ((times + apart) * (100 + percent) >= percent * (len(query) + n))
        found, overlap, n = found[fits], times[fits], n[fits]
        if not len(found):
            continue
        if len(found) * 64 < len(sets):
            probes = np.sort(query[long])
            for i, s in enumerate(found.tolist() if apart else []):
                other = sets[s]
                overlap[i] += (other[np.minimum(np.searchsorted(other, probes), len(other) - 1)] == probes).sum()
        elif apart:  # most sets are candidates: one pass over the long lists probes all of them
            m = (hi - lo)[long]
            at = np.repeat(lo[long] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
            overlap = overlap + np.bincount(owner[at], minlength=len(sets))[found]
        found = found[overlap * (100 + percent) >= percent * (len(query) + n)]
        if len(found):
            yield q, found


def divide_skip(queries: list[np.ndarray], sets: list[np.ndarray], percent: int = PERCENT) -> Iterator[tuple[int, int]]:
    """All (query, set) pairs that link."""
    for q, found in matches(queries, sets, percent):
        for s in found.tolist():
            yield q, s


def tile_degrees(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of each set of left and then right: links between left and right (None: inside left), and the first set of its component by them."""
    at = 0 if right is None else len(left)
    n = len(left) + (len(right) if right is not None else 0)
    links, root = np.zeros(n, np.int64), np.arange(n)
    for q, found in matches(left, left if right is None else right, percent):
        found = found[found != q] if right is None else found + at
        links[q] += len(found)
        if right is not None:
            links[found] += 1
        own = np.unique(root[np.append(found, q)])
        if len(own) > 1:
            root[np.isin(root, own)] = own[0]
    return links, root


class Order:
    """Classes of shingles: 0 unique, 1 repeated, 2 not counted, 3 and more frequent."""

    def __init__(self, bits: np.ndarray, hot: np.ndarray, level: np.ndarray):
        self.bits, self.hot, self.level = bits, hot, level

    def unique(self, s: np.ndarray) -> np.ndarray:
        return (s < _TOP) & ~self.repeated(s)

    def repeated(self, s: np.ndarray) -> np.ndarray:
        slot = s >> np.uint64(64 - len(self.bits).bit_length() - 2)
        return (self.bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def classes(self, s: np.ndarray) -> np.ndarray:
        found = np.where(self.repeated(s), 1, np.where(s < _TOP, 0, 2))
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, s), len(self.hot) - 1)
            found = np.where(self.hot[at] == s, 3 + self.level[at], found)
        return found


def prefix(s: np.ndarray, order: Order, percent: int = PERCENT) -> np.ndarray:
    """The first shingles of a set that may occur in other sets."""
    length = min(len(s), len(s) - needed(len(s), percent) + K)
    if not len(s) or int(order.unique(s).sum()) >= length:
        return s[:0]
    classes = order.classes(s)
    first = np.argsort(classes, kind="stable")[:length]
    return s[first[classes[first] > 0]]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")


def _order(docs: DataFrame, words: int) -> Order:
    """Counts shingles over all documents; what comes to the driver has MAX_BITS bits and MAX_HOT shingles at most.

    Shingles travel as sorted arrays by hash range, BUCKET_SHINGLES or so in a range, not as rows.
    """
    expected = (docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0) / BYTES_A_WORD * ZONE
    b_bits = max(6, int(expected / BUCKET_SHINGLES).bit_length())
    n_bits = min(MAX_BITS, max(1 << b_bits + 3, 1 << (2 * int(expected)).bit_length()))
    bucket_of, slot_of, per_bucket = np.uint64(64 - b_bits), np.uint64(64 - n_bits.bit_length() + 1), n_bits >> b_bits

    def zone(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            parts = [s if len(s) <= SMALL else s[: np.searchsorted(s, _TOP)] for _, block in blocks(batch.column(1)) for s in shingle_sets(block, words)]
            held = np.sort(np.concatenate([*parts, np.zeros(0, np.uint64)]))
            bucket = held >> bucket_of
            first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(held) else np.zeros(0, int)
            ends = np.append(first[1:], len(held))[: len(first)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int64)), pa.array([held[i:j].tobytes() for i, j in zip(first, ends, strict=True)], pa.binary())], ["bucket", "shingles"])

    def count(group):
        import pandas as pd

        held = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in group.shingles]))
        at = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
        n = np.diff(np.append(at, len(held)))
        s, n = held[at[n > 1]], n[n > 1]
        bits = np.zeros(per_bucket, bool)
        bits[((s >> slot_of) & np.uint64(per_bucket - 1)).astype(np.int64)] = True
        hot = n > SHORT
        return pd.DataFrame({"bucket": [group.bucket.iat[0]], "bits": [np.packbits(bits, bitorder="little").tobytes()], "hot": [s[hot].view(np.int64).tolist()], "level": [np.log2(n[hot]).astype(int).tolist()]})

    counts = _texts(docs).mapInArrow(zone, "bucket long, shingles binary").groupBy("bucket").applyInPandas(count, "bucket long, bits binary, hot array<long>, level array<int>")
    counts = materialize(counts, "counts")
    hot = counts.select(F.explode(F.arrays_zip("hot", "level")).alias("x")).select("x.hot", "x.level")
    levels = {r["level"]: r["n"] for r in hot.groupBy("level").agg(F.count("*").alias("n")).collect()}
    least, held = 0, 0
    for level in sorted(levels, reverse=True):
        if (held := held + levels[level]) > MAX_HOT:
            least = level + 1
            break
    bits = np.zeros(n_bits // 8, np.uint8)
    for bucket, part in counts.select("bucket", "bits").toLocalIterator():
        bits[bucket * per_bucket // 8 : (bucket + 1) * per_bucket // 8] = np.frombuffer(part, np.uint8)
    top = hot.filter(F.col("level") >= least).toArrow()
    g = np.array(top.column(0), np.int64).view(np.uint64)
    at = np.argsort(g)
    return Order(bits, g[at], np.array(top.column(1), np.int64)[at])


def _sets(docs: DataFrame, held, percent: int, words: int) -> DataFrame:
    """doc_id, n, sid, posts, shingles: the last three null for sets that link with nothing and have no copies. held: a broadcast Order."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at, block in blocks(batch.column(1)):
                sets = shingle_sets(block, words)
                n, sid, posts, raw = [], [], [], []
                for s in sets:
                    first = prefix(s, held.value, percent)
                    n.append(len(s))
                    some = len(first) > 0
                    sid.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if some else None)
                    posts.append(first.view(np.int64) if some else None)
                    raw.append(s.tobytes() if some else None)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, block.n), pa.array(n, pa.int64()), pa.array(sid, pa.binary()), pa.array(posts, pa.list_(pa.int64())), pa.array(raw, pa.binary())], ["doc_id", "n", "sid", "posts", "shingles"])

    return _texts(docs).mapInArrow(run, "doc_id long, n long, sid binary, posts array<long>, shingles binary")


def components(links: DataFrame) -> DataFrame:
    """(v, label) for the ends of links (a, b): the least id of each component, by minima of neighbours and pointer jumps."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = materialize(both, "edges")
    labels = both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("a"), F.min("b")).alias("label"))
    labels = materialize(labels, "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "label"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        step = labels.join(near, "v", "left").select("v", F.least("label", "near").alias("next"), "label")
        jump = step.select(F.col("v").alias("next"), F.col("next").alias("far"))
        before, step = labels, materialize(step.join(jump, "next", "left").select("v", F.least("next", "far").alias("label"), (F.least("next", "far") < F.col("label")).alias("moved")), "labels")
        discard(before)
        if step.filter("moved").isEmpty():
            return step.select("v", "label")
        labels = step


def _short_pairs(posts: DataFrame, percent: int) -> DataFrame:
    """(a, b, times): pairs of sets that occur together in the required number of short lists."""
    lists = posts.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("n", "sid"))).alias("list"))
    lists = lists.groupBy("list").agg(F.count("*").alias("lists"))  # lists of the same sets count together
    pairs = F.expr(f"flatten(transform(list, (x, i) -> transform(filter(slice(list, i + 2, size(list)), y -> x.n * 100 >= {percent} * y.n), y -> struct(x.sid as a, y.sid as b, x.n as n))))")
    pairs = lists.select("lists", F.explode(pairs).alias("p")).groupBy("p.a", "p.b", "p.n").agg(F.sum("lists").alias("times"))
    return pairs.filter(F.col("times") >= F.least(F.lit(K), F.ceil(F.col("n") * percent / 100))).select("a", "b", "times")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, ok) of pairs (a, b)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            ok = [linked(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64), percent) for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    own = sets.select("sid", "shingles")
    rows = pairs.join(own.select(F.col("sid").alias("b"), F.col("shingles").alias("y")), "b").join(own.select(F.col("sid").alias("a"), F.col("shingles").alias("x")), "a")
    return rows.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary, ok boolean")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are not yet in one component."""
    la, lb = labels.select(F.col("v").alias("a"), F.col("label").alias("la")), labels.select(F.col("v").alias("b"), F.col("label").alias("lb"))
    both = pairs.join(la, "a", "left").join(lb, "b", "left")
    return both.filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select(*pairs.columns)


def _short_links(posts: DataFrame, sets: DataFrame, clusters: DataFrame, percent: int) -> DataFrame:
    """All links (a, b) over short lists between sets that are not in one cluster."""
    pairs = materialize(_apart(_short_pairs(posts, percent), clusters).select("a", "b"), "pairs")
    with small_batches(posts.sparkSession):
        return materialize(_verify(pairs, sets, percent).filter("ok").select("a", "b"), "links")


def _tile_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """sid, root, n_links of members (cluster, sid, n): links inside the cluster, by pairs of its tiles; sets with one root are in one component."""
    sizes = members.groupBy("cluster").agg(F.count("*").alias("all"), F.sum("n").alias("shingles"))
    tiles = F.ceil(F.greatest(F.col("all") / TILE, F.col("shingles") / TILE_SHINGLES)).cast("int")
    held = join_stats(members, materialize(sizes.select("cluster", "all", tiles.alias("tiles")), "sizes"), "cluster", "all")
    held = held.join(sets.select("sid", "shingles"), "sid").withColumn("tile", F.pmod(F.xxhash64("sid", F.lit(9)), F.col("tiles")).cast("int"))
    held = held.select("cluster", "sid", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"), "shingles")
    held = held.select("cluster", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "sid", "tile", "shingles")

    def run(group):
        import pandas as pd

        low, high = group.low.iat[0], group.high.iat[0]
        group = group.sort_values("tile", kind="stable")
        held = [np.frombuffer(x, np.uint64) for x in group.shingles]
        n = int((group.tile == low).sum())
        links, root = tile_degrees(held[:n], None if low == high else held[n:], percent)
        sid = group.sid.to_numpy()
        return pd.DataFrame({"sid": sid, "root": sid[root], "n_links": links})[links > 0]

    return held.groupBy("cluster", "low", "high").applyInPandas(run, "sid binary, root binary, n_links long")


def near_copies(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (least id with the same set), n_links (of the set with other sets)."""
    with small_batches(docs.sparkSession, 1024):
        order = docs.sparkSession.sparkContext.broadcast(_order(docs, words))
        rows = materialize(_sets(docs, order, percent, words), "sets")
        order.unpersist()
    some = rows.filter("sid is not null")
    classes = materialize(some.groupBy("sid").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies")), "classes")
    sets = materialize(some.groupBy("sid").agg(F.first(F.struct("n", "posts", "shingles")).alias("s")).select("sid", "s.*"), "distinct")
    posts = sets.select("sid", "n", F.explode("posts").alias("g"))
    sizes = materialize(posts.groupBy("g").agg(F.count("*").alias("size"), F.min("sid").alias("b")).filter("size > 1"), "sizes")
    posts = materialize(join_stats(posts, sizes, "g", "size"), "posts")
    clusters = components(posts.filter(F.col("size") > SHORT).select(F.col("sid").alias("a"), "b"))  # all members of a list with its first
    members = materialize(clusters.select(F.col("label").alias("cluster"), F.col("v").alias("sid")).join(sets.select("sid", "n"), "sid"), "members")
    inside = materialize(_tile_links(members, sets, percent), "links")
    links = _short_links(posts.filter(F.col("size") <= SHORT).select("sid", "n", "g"), sets, clusters, percent)
    labels = components(links.unionByName(inside.select(F.col("sid").alias("a"), F.col("root").alias("b"))))
    one = F.lit(1).cast("long").alias("n_links")
    degree = links.select(F.col("a").alias("sid"), one).unionByName(links.select(F.col("b").alias("sid"), one)).unionByName(inside.select("sid", "n_links"))
    degree = degree.groupBy("sid").agg(F.sum("n_links").alias("n_links"))
    named = classes.join(labels.select(F.col("v").alias("sid"), "label"), "sid", "left").join(degree, "sid", "left")
    named = materialize(named.select("sid", "class_id", "copies", F.coalesce("label", "sid").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "named")
    least = materialize(named.groupBy("label").agg(F.min("class_id").alias("component_id"), F.count("*").alias("classes")), "least")
    named = materialize(join_stats(named, least, "label", "classes").select("sid", "copies", "class_id", "component_id", "n_links"), "named")
    for written in (classes, sets, sizes, posts, members, inside, links, least):
        discard(written)
    # A set may have a third of all rows as copies, a component a third of all sets.
    joined = join_stats(some.select("doc_id", F.col("n").alias("n_shingles"), "sid"), named, "sid", "copies").select("doc_id", "n_shingles", "component_id", "class_id", "n_links")
    alone = rows.filter("sid is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return alone.unionByName(joined)


def drop_near_copies(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """docs with one row of each component, the one with its least id; all columns. Rows without an id stay, as do all rows that repeat a staying id."""
    found = near_copies(docs, percent, words)
    return drop_ids(docs, found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id"))

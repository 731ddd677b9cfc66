"""Benchmark decontamination with spaced seeds.

Each mask of MASKS names the token positions that a seed hashes; the others may
differ. Together they hit every aligned window of WINDOW tokens with up to 3
substituted tokens. Shorter items, and texts shorter than WINDOW and the item, have
pieces instead: one more than the tokens that MATCH lets differ. Test hashes are joined with the hashes at every token of every
training text; around each hit the item is aligned and its windows of WINDOW
tokens (of the whole item or text, if shorter) are compared: an overlap of MATCH or more
makes the document contaminated by the item.

The benchmark is taken in blocks of at most BLOCK_TOKENS tokens, each broadcast; a
task holds one of them at a time, so the benchmark's size does not matter for memory. Texts are
split and hashed once for all blocks, in one stage, without a shuffle of the documents.

Repeated tokens: neighbouring equal seeds are one run, in texts and in items; runs
that meet give a range of alignments, ranges are joined, and alignments are compared
CELLS tokens at a time, so memory does not grow with the length of a text or item.

Defined cases: words are runs of ASCII letters, digits and bytes over 127, A-Z
lower-cased; null and empty texts and texts without words have no overlap; items
with fewer than WINDOW words are found whole, with the substitutions that MATCH
allows at their length (none under 5 words); a text of FRAGMENT words or more that is
shorter than an item is found as a part of it, shorter ones only if they hold a whole
item; items without words are never found; repeated items are each reported; texts are read whole; empty
tables give no overlaps; other columns are ignored (kept by ``drop_contaminated``).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiform.llm.common import iterator_udf
from lexiform.llm.wordhash import NOT_ALNUM, Block, blocks, mix

MASKS = [(0, 1, 3, 4, 7, 9), (0, 1, 2, 4, 6, 7), (0, 1, 2, 3, 4, 5)]
WINDOW, MATCH, BLOCK_TOKENS, FILTER_BITS = 16, 0.8, 1_000_000, 22
#: Pairs of runs and compared tokens that are in memory at once; bytes of texts that meet a block of the benchmark before the next is read.
PAIRS, CELLS, HELD_BYTES = 1 << 18, 1 << 18, 1 << 25
#: Texts from this length on are compared as a whole with longer items; they are looked up by the first PIECE tokens of their pieces.
FRAGMENT, PIECE = 8, 3
HIT = "struct<item_id:long,start:long,end:long,overlap:double>"
_FACTORS = np.random.default_rng(5).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _seeds(h: np.ndarray, mask: tuple[int, ...], salt: int) -> np.ndarray:
    """Hashes of the masked tokens at every position where the mask fits."""
    n = max(0, len(h) - mask[-1])
    out = np.full(n, salt + 1, np.uint64)
    for j, o in enumerate(mask):
        out = out * np.uint64(0x100000001B3) + h[o : o + n] * _FACTORS[j]
    return mix(out)


def pieces(n: int) -> list[tuple[int, int]]:
    """(first, length): parts of a window of n tokens, one of which is whole if the window reaches MATCH."""
    k = int(n * (1 - MATCH) + 1e-9) + 1
    cuts = [i * n // k for i in range(k + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


class Index:
    """Seeds of some benchmark items."""

    def __init__(self, items: list[tuple[int, str]]):
        import pyarrow as pa

        self.ids, self.tokens = [], []
        for at, block in blocks(pa.array([t or "" for _, t in items], pa.string())):
            starts, ends, first = block.words(NOT_ALNUM)
            h = block.hashes(starts, ends)
            for i in range(block.n):
                self.ids.append(items[at + i][0])
                self.tokens.append(h[first[i] : first[i + 1]])
        self.masks = list(MASKS)
        lengths = {n for t in self.tokens if 0 < len(t) < WINDOW for _, n in pieces(len(t))}
        self.masks += [tuple(range(n)) for n in sorted(lengths)]
        whole = {len(mask): m for m, mask in enumerate(self.masks) if m >= len(MASKS)}
        self.part = len(self.masks)  # salt of the pieces of short texts
        keys, item, place = [], [], []
        for k, t in enumerate(self.tokens):
            if len(t) >= WINDOW:
                own = [(_seeds(t, mask, m), 0) for m, mask in enumerate(MASKS)]
            else:
                own = [(_seeds(t[at : at + n], self.masks[whole[n]], whole[n]), at) for at, n in pieces(len(t))] if len(t) else []
            if len(t) > FRAGMENT:
                own.append((_seeds(t, tuple(range(PIECE)), self.part), 0))
            for found, at in own:
                keys.append(found)
                item.append(np.full(len(found), k))
                place.append(np.arange(at, at + len(found)))
        keys, item, place = (np.concatenate([*x, np.zeros(0, t)]).astype(t) for x, t in ((keys, np.uint64), (item, np.int32), (place, np.int32)))
        order = np.lexsort((place, item, keys))
        keys, item, place = keys[order], item[order], place[order]
        # Neighbouring places of one seed in one item are a run: its first place and its length.
        end = np.concatenate([(keys[1:] != keys[:-1]) | (item[1:] != item[:-1]) | (place[1:] > place[:-1] + 1), [True]]) if len(keys) else np.zeros(0, bool)
        last = np.flatnonzero(end)
        begin = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
        self.keys, self.item, self.place, self.run = keys[last], item[last].astype(np.int64), place[begin].astype(np.int64), (place[last] - place[begin] + 1).astype(np.int64)
        self.size = np.array([len(t) for t in self.tokens], np.int64)
        self.base = np.cumsum(self.size) - self.size
        self.all_tokens = np.concatenate([*self.tokens, np.zeros(0, np.uint64)])
        del self.tokens
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.keys >> np.uint64(64 - FILTER_BITS)] = True

    def _runs(self, seeds: np.ndarray, at: np.ndarray, doc: np.ndarray) -> Iterator[np.ndarray]:
        """Rows (text, item, least start, number of starts): the alignments at which a seed of the text meets its like in an item.

        Neighbouring positions of equal seeds, in the text and in an item, are one run: two runs of any length give one row.
        """
        if not len(at):
            return
        new = np.concatenate([[True], (seeds[1:] != seeds[:-1]) | (at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]])])
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, len(at)))
        lo, hi = np.searchsorted(self.keys, seeds[first], "left"), np.searchsorted(self.keys, seeds[first], "right")
        n = hi - lo
        ends = np.cumsum(n)
        at_most = 0
        while at_most < len(n):  # PAIRS pairs of runs at a time, or those of one run
            start = at_most
            at_most = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, "right")))
            m = n[start:at_most]
            if not m.sum():
                continue
            rows = np.repeat(lo[start:at_most] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
            where, long = np.repeat(at[first[start:at_most]], m), np.repeat(length[start:at_most], m)
            yield np.stack([doc[where], self.item[rows], where - self.place[rows] - self.run[rows] + 1, long + self.run[rows] - 1], 1)

    @staticmethod
    def _joined(rows: list[np.ndarray]) -> np.ndarray:
        """Such rows with those of one text and item that overlap or touch made one, in order."""
        held = np.concatenate(rows)
        order = np.lexsort((held[:, 2], held[:, 1], held[:, 0]))
        d, k, low, high = held[order, 0], held[order, 1], held[order, 2], held[order, 2] + held[order, 3]
        same = np.concatenate([[False], (d[1:] == d[:-1]) & (k[1:] == k[:-1])])
        # The farthest end so far inside each (text, item): groups are moved apart so that one running maximum serves all.
        apart = np.cumsum(~same) * (int(high.max() - low.min()) + 2)
        reach = np.maximum.accumulate(high + apart) - apart
        at = np.flatnonzero(np.concatenate([[True], ~(same[1:] & (low[1:] <= reach[:-1]))]))
        return np.stack([d[at], k[at], low[at], reach[np.append(at[1:], len(d)) - 1] - low[at]], 1)

    @staticmethod
    def _starts(ranges: np.ndarray) -> Iterator[np.ndarray]:
        """Rows (text, item, start), CELLS / WINDOW at a time or so."""
        step = CELLS // WINDOW
        ends = np.cumsum(ranges[:, 3])
        for begin in range(0, int(ends[-1]), step):
            number = np.arange(begin, min(begin + step, int(ends[-1])))
            i = np.searchsorted(ends, number, "right")
            yield np.stack([ranges[i, 0], ranges[i, 1], ranges[i, 2] + number - (ends[i] - ranges[i, 3])], 1)

    def _verified(self, h: np.ndarray, first: np.ndarray, pairs: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
        """The best window of each alignment (text, item, start) that reaches MATCH."""
        d, k, start = pairs.T
        words, size = first[d + 1] - first[d], self.size[k]
        width = np.minimum(size, WINDOW)
        width = np.where((words >= FRAGMENT) & (words < width), words, width)
        lo, hi = np.maximum(start, first[d]), np.minimum(start + size, first[d + 1])
        fits = hi - lo >= width
        d, k, start, width, lo, hi = (x[fits] for x in (d, k, start, width, lo, hi))
        ends = np.cumsum(hi - lo)
        at = 0
        while at < len(d):  # CELLS compared tokens at a time, or those of one alignment
            begin = at
            at = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + CELLS, "right")))
            n = (hi - lo)[begin:at]
            head = np.concatenate([[0], np.cumsum(n)[:-1]])
            inside = np.arange(n.sum()) - np.repeat(head, n)
            text = np.repeat(lo[begin:at], n) + inside
            item = np.repeat(self.base[k[begin:at]] + lo[begin:at] - start[begin:at], n) + inside
            sums = np.concatenate([[0], np.cumsum(h[text] == self.all_tokens[item])])
            w = np.repeat(width[begin:at], n)
            last = inside + w <= np.repeat(n, n)
            cell = np.arange(len(inside))
            share = np.where(last, sums[np.minimum(cell + w, len(cell))] - sums[cell], -1)
            most = np.maximum.reduceat(share, head)
            for i in np.flatnonzero(most >= MATCH * width[begin:at] - 1e-9).tolist():
                j = begin + i
                best = int(np.argmax(share[head[i] : head[i] + n[i]]))
                yield int(d[j]), int(k[j]), int(lo[j]) + best, int(lo[j]) + best + int(width[j]), float(most[i] / width[j])

    def hits(self, words: tuple[np.ndarray, np.ndarray], n_texts: int) -> Iterator[tuple[int, int, int, int, float]]:
        """(text, item, first token, end token, overlap) of the best window of every alignment that reaches MATCH. words: hashes, first of each text."""
        h, first = words
        if not len(h) or not len(self.keys):
            return
        doc, rows, held, most = np.repeat(np.arange(n_texts), np.diff(first)), [], 0, 4 * PAIRS

        def look(seeds: np.ndarray, at: np.ndarray) -> None:
            nonlocal rows, held, most
            for new in self._runs(seeds, at, doc):
                rows.append(new)
                held += len(new)
                if held > most:  # what is left after joining is bounded by the alignments that there are
                    rows = [self._joined(rows)]
                    held = len(rows[0])
                    most = max(most, 2 * held)

        for m, mask in enumerate(self.masks):
            seeds = _seeds(h, mask, m)
            at = np.flatnonzero(self.filter[seeds >> np.uint64(64 - FILTER_BITS)])
            at = at[doc[at] == doc[at + mask[-1]]]
            look(seeds[at], at)
        count = np.diff(first)
        if ((count >= FRAGMENT) & (count < WINDOW)).any():
            seeds = _seeds(h, tuple(range(PIECE)), self.part)
            for n in range(FRAGMENT, WINDOW):
                short = first[:-1][count == n]
                for a, _ in pieces(n) if len(short) else []:
                    look(seeds[short + a], short + a)
        if rows:
            for pairs in self._starts(self._joined(rows)):
                yield from self._verified(h, first, pairs)


def _indexes(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str) -> list:
    """A broadcast Index for each block of at most about BLOCK_TOKENS tokens of the benchmark; the driver builds one at a time."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text") / 4)).first()[0] or 0
    n, held = int(total // BLOCK_TOKENS) + 1, []
    for b in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()  # about BLOCK_TOKENS tokens
        held.append(docs.sparkSession.sparkContext.broadcast(Index(sorted((r[0] if r[0] is not None else -1, r[1]) for r in rows))))
    return held


class _Texts:
    """Some whole texts, split and hashed once for all blocks of the benchmark."""

    def __init__(self, block: Block):
        self.block, self.n = block, block.n
        self.starts, self.ends, self.first = block.words(NOT_ALNUM)
        self.h = block.hashes(self.starts, self.ends)
        block._sums = None  # eight bytes a byte of text


def _overlaps(columns: list, indexes: list) -> list[list[dict]]:
    """The contaminating items of each text of some Arrow columns: the best alignment of each. Of several blocks of the benchmark one is in memory at a time."""
    texts: Iterable[_Texts] = (_Texts(block) for column in columns for _, block in blocks(column))
    if len(indexes) > 1:
        texts = list(texts)
    out: list[list[dict]] = [[] for _ in range(sum(map(len, columns)))]
    for held in indexes:
        index, base = held.value, 0
        for t in texts:
            own: dict[tuple[int, int], tuple] = {}
            for d, k, start, end, overlap in index.hits((t.h, t.first), t.n):
                if (d, k) not in own or own[d, k][2] < overlap:
                    own[d, k] = start, end, overlap
            if own:
                points = np.concatenate([[0], np.cumsum((t.block.raw & 0xC0) != 0x80)])
            for d, k in sorted(own):
                start, end, overlap = own[d, k]
                at = points[t.block.off[d]]
                out[base + d].append({"item_id": index.ids[k], "start": int(points[t.starts[start]] - at), "end": int(points[t.ends[end - 1]] - at), "overlap": overlap})
            base += t.n
        if len(indexes) > 1:
            held.__dict__.pop("_value", None)  # read again from its local file for the next texts
    return out


def _gathered(batches: Iterator, text, several: bool) -> Iterator[list]:
    """Batches in lists: one by one for one block of the benchmark, else until their texts have HELD_BYTES, so that blocks are seldom changed."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += text(batch)
        if not several or n >= HELD_BYTES:
            yield held
            held, n = [], 0
    if held:
        yield held


def find_overlaps(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """doc_id, contaminated, item_ids, best_overlap, hits (with code-point spans) of every row of docs. No shuffle."""
    indexes = _indexes(docs, benchmark, item_col, text_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("overlap", pa.float64())]))
        for held in _gathered(batches, lambda b: b.column(1).nbytes, len(indexes) > 1):
            ids = pa.concat_arrays([b.column(0) for b in held])
            yield pa.RecordBatch.from_arrays([ids, pa.array(_overlaps([b.column(1) for b in held], indexes), kind)], ["doc_id", "hits"])

    out = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(run, f"doc_id long, hits array<{HIT}>")
    ids = F.array_sort(F.transform("hits", lambda h: h["item_id"]))
    return out.select("doc_id", (F.size("hits") > 0).alias("contaminated"), ids.alias("item_ids"), F.coalesce(F.array_max(F.transform("hits", lambda h: h["overlap"])), F.lit(0.0)).alias("best_overlap"), "hits")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """docs without the contaminated rows; all columns, no shuffle."""
    indexes = _indexes(docs, benchmark, item_col, text_col)

    def clean(texts):
        import pyarrow as pa

        for held in _gathered(texts, lambda t: t.nbytes, len(indexes) > 1):
            found = _overlaps(held, indexes)
            for t in held:
                yield pa.array([not x for x in found[: len(t)]], pa.bool_())
                found = found[len(t) :]

    return docs.filter(iterator_udf(clean, "boolean")(F.col("text").cast("string")))

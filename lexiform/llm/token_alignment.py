"""Cross-tokenizer alignment as relations over tokens.

Two tokenizers cut the same bytes. Tokens are exploded with their places, windows sum
their lengths to ends, and an equi-join on (text, end) finds the offsets where both cut; running
counts of these cuts number the groups of tokens that cover the same bytes. It is a full join, stated as a grouping of both
sides by its key (ends are unique on a side), because Spark keeps the partitioning of a grouping but not that of a full
join: its rows are the byte ranges between neighbouring ends of any kind. Each of them lies in exactly one token of either side, and two overlapping tokens share exactly one
of them: with the next token of both sides filled in, the rows are the links.

Where tokens meet depends on their lengths alone. So the relations hold shapes, which are pairs of lists of token lengths, and a
token stands in them as its place in its list: each distinct shape of a chunk is aligned once, for all texts that have it.

Both tokenizers work on words alone where the vocabularies prove it (``Tokenizers.by_words``): the pattern of
the first one ends a match before a space between two other characters, and no piece of the second
one holds such a space behind its first character. So texts are taken apart there. Documents travel in chunks of
bounded size, as codes of their segments; the distinct segments of a chunk, joined by spaces, are one text, which is
tokenized once. Segments that start or end with white space or fail are texts of their own.
Vocabularies that do not prove it leave texts whole; nothing else changes.

Chunks are written in buckets by their number, so neither they nor their tokens are shuffled. A chunk sends each of its id
pairs once, with the number of its documents, so no frequent pair is a hot key; the corpus-wide counts come back the same way.

Defined cases: null and empty texts, and texts whose joined token bytes differ from a space and the text, have
no tokens: zeros and an empty digest column, and they do not count as documents of a pair; rows and ids may
repeat, each row counts; texts of any length are read whole; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import chain, count

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiform.llm.common import bucketed, discard, materialize, small_batches

#: Bytes of text in a chunk; a longer document is a chunk of its own.
CHUNK = 4 << 20
SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
CHUNKS = "chunk long, doc_ids array<long>, sizes binary, codes binary, shapes binary, a_ids binary, b_ids binary, a array<array<int>>, b array<array<int>>"
PASSED = "chunk long, doc_ids array<long>, figures binary, digests array<string>, sizes binary, codes binary, bad binary, n_links binary, links binary, pairs array<long>, documents array<long>"
#: Joined texts that are tokenized at a time.
PARTS = 16
#: A space between two characters that are no white space, and one beside white space.
BETWEEN, BESIDE = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"\s | \s")


def packed(x: np.ndarray) -> bytes:
    """Numbers as compressed bytes."""
    import pyarrow as pa

    raw = np.ascontiguousarray(x).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes, kind=np.int32) -> np.ndarray:
    import pyarrow as pa

    return np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), kind)


def byte_of_char() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 ones for themselves, the others from U+0100 on in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers from the bytes of their files, and the bytes of every entry. The first has a space put before each text, the second adds its own."""

    def __init__(self, a_file: bytes, b_file: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self._a, self._b = Tokenizer.from_buffer(a_file), sentencepiece.SentencePieceProcessor(model_proto=b_file)
        self._a.encode_special_tokens = True
        chars, entries = byte_of_char(), self._a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.a_bytes[i] = bytes(chars[c] for c in entry) if all(c in chars for c in entry) else entry.encode()
        pieces = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self._b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        said = json.loads(a_file)
        pattern = said.get("pre_tokenizer") or {}
        self.by_words = (
            said.get("normalizer") is None and pattern.get("type") == "ByteLevel" and pattern.get("use_regex", True) and not pattern.get("add_prefix_space")
            and not any(re.search("[^▁]▁", p) for p in pieces)
        )

    def segments(self, text: str) -> list[str]:
        """What stands between the spaces at which both always cut; joined by a space they are the text."""
        if not self.by_words:
            return [text]
        plain = text[0] != " " and text[-1] != " " and not BESIDE.search(text)
        return text.split(" ") if plain else BETWEEN.split(text)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both sides over the texts one after the other, a space before each; none if either side's bytes differ from that."""
        a = [x.ids for x in self._a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        b, none = self._b.encode(texts, num_threads=1), np.zeros(0, np.int32)
        for t, x, y in zip(texts, a, b, strict=True):
            want = (" " + t).encode()
            if not t or any(b"".join(map(table.__getitem__, ids)) != want for ids, table in ((x, self.a_bytes), (y, self.b_bytes))):
                return none, none
        flat = lambda side: np.fromiter(chain.from_iterable(side), np.int32, sum(map(len, side)))
        return flat(a), flat(b)

    def units(self, words: list[str], part: int = 1000) -> tuple[list[int], int, list[tuple[np.ndarray, np.ndarray]]]:
        """(order, number of joined words, ids by unit): words in an order in which the joined ones come first; unit 0 is their text, each other word is a unit."""

        def joined(held: list[int]) -> tuple[np.ndarray, np.ndarray]:
            # A few parts at a time: what the libraries return of a part is many times its ids.
            parts, found = [held[k : k + part] for k in range(0, len(held), part)], [(np.zeros(0, np.int32),) * 2]
            for k in range(0, len(parts), PARTS):
                found.append(self.encode([" ".join([words[i] for i in p]) for p in parts[k : k + PARTS]]))
                if not len(found[-1][0]):
                    return found[0]
            return tuple(map(np.concatenate, zip(*found, strict=True)))

        odd = [not self.by_words or not w or w[0].isspace() or w[-1].isspace() or "▁" in w for w in words]
        order = [i for i, x in enumerate(odd) if not x]
        ids = joined(order)
        if order and not len(ids[0]):  # some word fails: find it
            odd = [x or not len(self.encode([w])[0]) for x, w in zip(odd, words, strict=True)]
            order = [i for i, x in enumerate(odd) if not x]
            ids = joined(order)
        rest = [i for i, x in enumerate(odd) if x]
        return order + rest, len(order), [ids, *(self.encode([words[i]]) for i in rest)]

    def by_segment(self, words: list[str]) -> tuple[list[int], list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """An order of words, and of either side: the ids of all words in that order, the bytes of each id, and the number of ids by word."""
        order, n_joined, ids_of = self.units(words)
        joined, sides = np.cumsum([len(words[i].encode()) + 1 for i in order[:n_joined]]), []
        for k, table in enumerate((self.a_bytes, self.b_bytes)):
            ids = np.concatenate([x[k] for x in ids_of])
            sizes = np.fromiter(map(len, table), np.int32, len(table))[ids]
            # Both sides cut where a joined word ends.
            numbers = np.diff(np.searchsorted(np.cumsum(sizes[: len(ids_of[0][k])]), joined, side="right"), prepend=0)
            sides.append((ids, sizes, np.concatenate([numbers, [len(x[k]) for x in ids_of[1:]]]).astype(np.int64)))
        return order, sides


def shaped(sides: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, list]:
    """The number of each word's shape, and the shapes' lists of token lengths by side. sides: of Tokenizers.by_segment()."""
    import pyarrow as pa

    codes, lists = [], []
    for _, sizes, numbers in sides:
        at = np.concatenate([[0], np.cumsum(numbers)])
        said = pa.Array.from_buffers(pa.large_binary(), len(numbers), [None, pa.py_buffer(at * sizes.itemsize), pa.py_buffer(np.ascontiguousarray(sizes))])
        codes.append(said.dictionary_encode().indices.to_numpy().astype(np.int64))
        lists.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(sizes)))
    _, some, shapes = np.unique(codes[0] * (1 + codes[1].max(initial=0)) + codes[1], return_index=True, return_inverse=True)
    return shapes.astype(np.int32), [x.take(pa.array(some)) for x in lists]


def _tokenizers(files, held: dict = {}) -> Tokenizers:  # noqa: B006
    """A worker's tokenizers outlive the task and stay on its core. files: a broadcast of both files."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    content = files.value
    key = tuple(hashlib.sha256(x).digest() for x in content)
    if held.get("key") != key:
        held.update(key=key, both=Tokenizers(*content))
    return held["both"]


def chunked(docs: DataFrame, files, size: int = CHUNK) -> DataFrame:
    """Documents in chunks (CHUNKS): sizes are their numbers of segments, codes the segments' places in the chunk's order, shapes the segments' shapes
    in that order, a_ids and b_ids their token ids one after the other, a and b the shapes' token lengths."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        both = _tokenizers(files)
        first, ids, sizes, codes, words, held = None, [], [], [], defaultdict(count().__next__), 0

        def sent():
            names = list(words)
            order, sides = both.by_segment(names)
            place = np.zeros(len(names), np.int32)
            place[order] = np.arange(len(names), dtype=np.int32)
            shapes, lists = shaped(sides)
            own = np.concatenate(codes) if codes else np.zeros(0, np.int32)
            row = [pa.array([first], pa.int64()), pa.array([ids], pa.list_(pa.int64()))]
            row += [pa.array([packed(x)]) for x in (np.array(sizes, np.int32), place[own], shapes, sides[0][0], sides[1][0])]
            row += [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
            return pa.RecordBatch.from_arrays(row, [x.split()[0] for x in CHUNKS.split(", ")])

        for batch in batches:
            for rid, doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = value.as_py() or ""
                if first is not None and held + len(text) > size:
                    yield sent()
                    first, ids, sizes, codes, words, held = None, [], [], [], defaultdict(count().__next__), 0
                    pa.default_memory_pool().release_unused()
                first = rid if first is None else first
                own = both.segments(text) if text else []
                codes.append(np.fromiter(map(words.__getitem__, own), np.int32, len(own)))
                ids.append(doc_id)
                sizes.append(len(own))
                held += len(text)
        if first is not None:
            yield sent()

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, CHUNKS)


def ends(chunks: DataFrame) -> DataFrame:
    """(chunk, shape, end, a, b): every token of either side of a shape, as its place, with the offset where it ends; the other side's column is null."""
    sides = F.array(*(F.struct(F.lit(c).alias("side"), F.col(c).alias("lists")) for c in "ab"))
    shapes = chunks.select("chunk", F.inline(sides)).select("chunk", "side", F.posexplode("lists").alias("shape", "sizes"))
    placed = shapes.select("chunk", "side", "shape", F.posexplode("sizes").alias("place", "size"))
    w = Window.partitionBy("chunk", "shape", "side").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return placed.select("chunk", "shape", F.sum("size").over(w).alias("end"), *(F.when(F.col("side") == c, F.col("place")).alias(c) for c in "ab"))


def aligned(chunks: DataFrame) -> DataFrame:
    """(chunk, shape, end, a, b, a_over, b_over, group): the tokens that end at each offset, those that lie over the bytes up to it, and the number of cuts before it.

    All of it works by chunk, on the buckets of chunks.
    """
    merged = ends(chunks).groupBy("chunk", "shape", "end").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    text = Window.partitionBy("chunk", "shape")
    over = lambda c: F.last(c, ignorenulls=True).over(text.orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, 0))
    cut = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1).otherwise(0)
    before = F.coalesce(F.sum(cut).over(text.orderBy("end").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return merged.withColumn("a_over", over("a")).withColumn("b_over", over("b")).withColumn("group", before)


#: Segments whose links and groups are made at a time, and segments of documents whose pairs are counted at a time.
SAID, COUNTED = 1 << 14, 1 << 18
#: What may stand behind a token's number: a token of the same side and group, the other side, another group.
MARKS = ",|;"


@cache
def _said(most: int):
    """The numbers below most, each before every mark."""
    import pyarrow as pa

    return pa.array([f"{i}{mark}".encode() for mark in MARKS for i in range(most)], pa.large_binary())


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each of these, n of them, one after the other."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def distinct(x: np.ndarray) -> np.ndarray:
    """The different ones of numbers that are not negative, in order; x is sorted in place."""
    x.sort()
    return x[np.diff(x, prepend=-1) != 0]


def _of_segments(table, shapes: np.ndarray, a_ids: np.ndarray, b_ids: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray], list[bytes]]:
    """Links (id pairs) one segment after the other, the segments' figures, and their groups as text, each ending in a semicolon. table: a chunk's aligned rows."""
    import pyarrow as pa

    n = int(shapes.max(initial=-1)) + 1
    order = np.lexsort((table.column("end").to_numpy(), table.column("shape").to_numpy()))
    shape, a, b, a_over, b_over, group = (table.column(c).fill_null(-1).to_numpy()[order] for c in ("shape", "a", "b", "a_over", "b_over", "group"))
    figures = {"n_a": a >= 0, "n_b": b >= 0, "n_groups": (a >= 0) & (b >= 0), "n_links": np.ones(len(a), bool)}
    figures = {k: np.bincount(shape[v], minlength=n) for k, v in figures.items()}
    starts = {k: np.cumsum(v) - v for k, v in figures.items()}
    # A group's tokens of the first side, then those of the second, each with the mark behind it.
    place, side = np.concatenate([a[a >= 0], b[b >= 0]]), np.repeat([0, 1], [np.sum(a >= 0), np.sum(b >= 0)])
    of, group = (np.concatenate([x[a >= 0], x[b >= 0]]) for x in (shape, group))
    order = np.lexsort((place, side, group, of))
    place, side, of, group = (x[order] for x in (place, side, of, group))
    last = np.ones(len(of), bool)
    last[:-1] = (np.diff(of) != 0) | (np.diff(group) != 0) | (np.diff(side) != 0)
    mark = np.where(last, 1 + side, 0)

    figures = {k: v[shapes] for k, v in figures.items()}
    a_first, b_first, link_first = (np.concatenate([[0], np.cumsum(figures[k])]) for k in ("n_a", "n_b", "n_links"))
    most = 1 << int(max(a_ids.max(initial=1), b_ids.max(initial=1))).bit_length()
    links, said = np.empty(link_first[-1], np.int64), []
    for x in range(0, len(shapes), SAID):
        some = slice(x, x + SAID)
        times = figures["n_links"][some]
        row = spread(starts["n_links"][shapes[some]], times)
        links[link_first[x] : link_first[x] + len(row)] = a_ids[np.repeat(a_first[:-1][some], times) + a_over[row]].astype(np.int64) << 32 | b_ids[np.repeat(b_first[:-1][some], times) + b_over[row]]
        times = (figures["n_a"] + figures["n_b"])[some]
        row = spread((starts["n_a"] + starts["n_b"])[shapes[some]], times)
        second, ids = side[row] == 1, np.empty(len(row), np.int64)
        ids[~second] = a_ids[(np.repeat(a_first[:-1][some], times) + place[row])[~second]]
        ids[second] = b_ids[(np.repeat(b_first[:-1][some], times) + place[row])[second]]
        taken = _said(most).take(pa.array(mark[row] * most + ids))
        at = np.frombuffer(taken.buffers()[1], np.int64, len(row) + 1) if len(row) else np.zeros(1, np.int64)
        text = [None, pa.py_buffer(at[np.concatenate([[0], np.cumsum(times)])]), taken.buffers()[2] or pa.py_buffer(b"")]
        said += pa.Array.from_buffers(pa.large_binary(), len(times), text).to_pylist()
    return links, figures, said


def _named(df: DataFrame, *columns: str) -> DataFrame:
    """Columns of new identity, so that two frames of one origin can be grouped together."""
    return df.select(*(F.col(c).alias(c) for c in columns))


FIGURES = ["n_a", "n_b", "n_groups", "n_links"]


def _by_document(doc_first: np.ndarray, codes: np.ndarray, own: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(own[codes], dtype=np.int64)])
    return total[doc_first[1:]] - total[doc_first[:-1]]


def _of_chunk(left, right) -> list:
    """A chunk's row of PASSED. left: its row of CHUNKS; right: its aligned rows."""
    codes, sizes, *own = (unpacked(left.column(c)[0].as_py()) for c in ("codes", "sizes", "shapes", "a_ids", "b_ids"))
    links, figures, said = _of_segments(right, *own)
    n_links, n = figures["n_links"], len(own[0])
    first = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    doc = np.repeat(np.arange(len(sizes)), sizes)
    bad = sizes == 0
    bad[doc[figures["n_a"][codes] == 0]] = True
    table = np.stack([np.where(bad, 0, _by_document(first, codes, figures[c])) for c in FIGURES])
    # The last group has no mark behind it.
    digests = ["" if bad[i] else hashlib.sha256(memoryview(b"".join([said[k] for k in codes[first[i] : first[i + 1]].tolist()]))[:-1]).hexdigest() for i in range(len(sizes))]
    del said
    pairs, place = np.unique(links, return_inverse=True)
    place = place.astype(np.int32)
    del links
    # Distinct segments of each document, then distinct pairs, one document after the other in blocks.
    times, at = np.zeros(len(pairs), np.int64), np.concatenate([[0], np.cumsum(n_links)])
    good = ~bad[doc]
    held = distinct(doc[good] * n + codes[good])
    d, s = ((f(held, max(n, 1))).astype(np.int32) for f in (np.floor_divide, np.remainder))
    del doc, good, held
    for i in range(0, len(d), COUNTED):
        # A block ends where a document does.
        lo, hi = (np.searchsorted(d, d[x]) if x < len(d) else len(d) for x in (i, i + COUNTED))
        own = n_links[s[lo:hi]]
        both = distinct(np.repeat(d[lo:hi].astype(np.int64), own) * len(pairs) + place[spread(at[s[lo:hi]], own)])
        times += np.bincount(both % max(len(pairs), 1), minlength=len(pairs))
    return [left.column("chunk"), left.column("doc_ids"), [packed(table)], [digests], [packed(sizes)], [packed(codes)], [packed(bad)], [packed(n_links.astype(np.int32))], [packed(place)], [pairs], [times]]


def composed(chunks: DataFrame, rows: DataFrame) -> DataFrame:
    """A row a chunk (PASSED): its documents' figures and digests, and its id pairs with the number of its documents that hold them linked."""

    def run(left, right):
        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        out = dict(zip(names, _of_chunk(left, right), strict=True)) if left.num_rows else {}
        return pa.table({k: pa.array(out.get(k, []), t) if isinstance(out.get(k, []), list) else out[k].cast(t) for k, t in kinds.items()})

    import pyarrow as pa

    names = [x.split()[0] for x in PASSED.split(", ")]
    of = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    kinds = {x.split()[0]: of[x.split()[1]] for x in PASSED.split(", ")}
    left = _named(chunks, "chunk", "doc_ids", "sizes", "codes", "shapes", "a_ids", "b_ids")
    return left.groupBy("chunk").cogroup(_named(rows, *rows.columns).groupBy("chunk")).applyInArrow(run, PASSED)


def finished(passed: DataFrame, counts: DataFrame) -> DataFrame:
    """The result's rows. counts: chunk, at (the pair's place in its chunk), n (its documents corpus-wide), is_best."""

    def run(left, right):
        import pyarrow as pa

        names = [x.split()[0] for x in SCHEMA.split(", ")]
        out = [pa.array([], pa.string() if c == "groups_sha256" else pa.int64()) for c in names]
        if left.num_rows:
            codes, sizes, n_links, links = (unpacked(left.column(c)[0].as_py()) for c in ("codes", "sizes", "n_links", "links"))
            bad = unpacked(left.column("bad")[0].as_py(), bool)
            first, starts = (np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (sizes, n_links))
            figures = unpacked(left.column("figures")[0].as_py(), np.int64).reshape(len(FIGURES), -1)
            out = [left.column("doc_ids").combine_chunks().flatten(), *map(pa.array, figures)]
            for c in ("is_best", "n"):
                own = np.zeros(len(left.column("pairs")[0]), np.int64)
                own[right.column("at").to_numpy()] = right.column(c).to_numpy()
                total = np.concatenate([[0], np.cumsum(own[links])])
                out.append(pa.array(np.where(bad, 0, _by_document(first, codes, total[starts[1:]] - total[starts[:-1]]))))
            out.append(left.column("digests").combine_chunks().flatten())
        return pa.Table.from_arrays(out, names)

    return _named(passed, *(c for c in passed.columns if c != "documents")).groupBy("chunk").cogroup(_named(counts, *counts.columns).groupBy("chunk")).applyInArrow(run, SCHEMA)


def align_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document. a_path: a byte-level tokenizer's JSON; b_path: a sentence-piece model."""
    spark = docs.sparkSession
    with open(a_path, "rb") as a, open(b_path, "rb") as b:
        content = (a.read(), b.read())
    files, buckets = spark.sparkContext.broadcast(content), int(spark.conf.get("spark.sql.shuffle.partitions"))  # vocabularies: fixed size

    with small_batches(spark, 1024):
        chunks = bucketed(chunked(docs, files), "chunks", "chunk", buckets)
    passed = bucketed(composed(chunks, aligned(chunks)), "composed", "chunk", buckets)
    discard(chunks)
    own = passed.select("chunk", F.posexplode(F.arrays_zip("pairs", "documents")).alias("at", "x")).select("chunk", "at", F.col("x.pairs").alias("pair"), F.col("x.documents").alias("n"))
    counts = materialize(own.groupBy("pair").agg(F.sum("n").alias("n")), "pairs").withColumn("a", F.shiftright("pair", 32))
    best = counts.groupBy("a").agg(F.max("n").alias("most"))  # a row an A id: at most the vocabulary
    counts = counts.join(F.broadcast(best), "a").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("is_best"))
    return finished(passed, own.drop("n").join(counts, "pair").select("chunk", "at", "n", "is_best"))

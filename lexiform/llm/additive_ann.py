"""Approximate nearest neighbours by additive quantisation.

A vector's direction is the sum of one codeword from each of several codebooks, all of
full dimension: codebooks are fitted one after the other on what the ones before leave, and
encoding keeps the best few partial sums (beam search) instead of the best one. Beside
its codes a vector keeps two norms, its own and that of its sum, so that a score is
own norm / norm of the sum * the sum of table entries: for each query a table holds its
products with all codewords.

Queries meet the index in blocks. A task reads one block of queries and one stripe of the
index, keeps each query's best ``shortlist`` by table scores, and sends these only;
their original vectors are then scored in double precision and ranked.

The codebooks are fitted on SAMPLE vectors at most, chosen by a hash of the id; every row is indexed.

Defined cases: vectors that are null, empty, all zero or hold null or non-finite components take no
part, nor do those of another length than most rows have, and rows with a null id; every row but the
query's own is a candidate, also rows that repeat an id or a vector; ties stand in order of
vec_id; if there are no more than ``shortlist`` candidates, all of them are scored exactly; other columns do
not matter; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiform.llm.common import discard, materialize

#: Rows that codebooks are fitted on, at most.
SAMPLE = 16_384
BOOKS, WORDS, BEAM, ROUNDS = 32, 256, 4, 8
CODE_BLOCK, QUERY_BLOCK, STRIPE = 4096, 64, 1 << 20


class Codebooks:
    """Additive codebooks: [book, word, dimension], with beam-search encoding."""

    def __init__(self, words: np.ndarray):
        self.words = words.astype(np.float32)
        self.square = (self.words**2).sum(2)

    @classmethod
    def fit(cls, x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = ROUNDS, seed: int = 13) -> Codebooks:
        """Lloyd's rounds on the residuals, book by book. Directions (rows of x) have unit length; fewer rows than words repeat."""
        rng, rest = np.random.default_rng(seed), x.astype(np.float32)
        out = np.zeros((books, words, x.shape[1]), np.float32)
        for b in range(books):
            centre = rest[rng.permutation(len(rest))[np.arange(words) % len(rest)]].copy()
            for _ in range(rounds):
                near = (0.5 * (centre**2).sum(1) - rest @ centre.T).argmin(1)
                size = np.bincount(near, minlength=words)
                order = np.argsort(near, kind="stable")
                starts = np.concatenate([[0], np.cumsum(size)[:-1]])
                held = size > 0
                centre[held] = np.add.reduceat(rest[order], starts[held], axis=0) / size[held, None]
                lost = np.flatnonzero(~held)  # words without rows move to some row
                centre[lost] = rest[rng.integers(0, len(rest), len(lost))]
            near = (0.5 * (centre**2).sum(1) - rest @ centre.T).argmin(1)
            out[b], rest = centre, rest - centre[near]
        return cls(out)

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """[row, book] codes of the rows of x. Of each row's partial sums the ``beam`` nearest to the row are kept after every book."""
        n, d = x.shape
        codes, rest, error = np.zeros((n, 1, 0), np.uint8), x.astype(np.float32)[:, None], np.zeros((n, 1), np.float32)
        for b, words in enumerate(self.words):
            # What adding word w does to a partial sum's squared error, the row's own square left out.
            grown = (error[:, :, None] + self.square[b] - 2 * (rest.reshape(-1, d) @ words.T).reshape(n, -1, len(words))).reshape(n, -1)
            keep = min(beam, grown.shape[1])
            best = np.argpartition(grown, keep - 1, axis=1)[:, :keep]
            row, word = best // len(words), best % len(words)
            at = np.arange(n)[:, None]
            codes = np.concatenate([codes[at, row], word[:, :, None].astype(np.uint8)], axis=2)
            rest, error = rest[at, row] - words[word], grown[at, best]
        return codes[np.arange(n), error.argmin(1)]

    def sums(self, codes: np.ndarray) -> np.ndarray:
        return self.words[np.arange(len(self.words)), codes].sum(1)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """[query, book, word] products."""
        return np.einsum("qd,bwd->qbw", queries.astype(np.float32), self.words, optimize=True)


def looked_up(tables: np.ndarray, codes: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """[query, row] scores: the table entries that each row's codes name, summed and scaled."""
    total = np.zeros((len(tables), len(codes)), np.float32)
    for b in range(codes.shape[1]):
        total += tables[:, b].take(codes[:, b], axis=1)
    return total * scale


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(rid, vec_id, v) of the rows that take part, written once; and their dimension. rid tells rows that repeat an id apart."""
    v = F.transform(F.col(f"`{vec_col}`"), lambda x: x.cast("double"))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    rows = materialize(rows.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    by_size = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    d = by_size[0]["d"] if by_size else 0
    return rows.filter(F.size("v") == d), d


def _matrix(column, d: int) -> np.ndarray:
    """Rows of an Arrow list column."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows and norms; a row is scaled by its largest component first, so no square overflows."""
    top = np.abs(x).max(1)
    y = x / top[:, None]
    norm = np.sqrt((y * y).sum(1))
    return y / norm[:, None], norm * top


def fit_codebooks(rows: DataFrame, d: int, sample: int = SAMPLE, **settings) -> Codebooks:
    """From at most ``sample`` rows, by a hash of the id and the row; they are all that comes to the driver."""
    share = min(1.0, sample / max(1, rows.count()))
    picked = rows.filter(F.pmod(F.xxhash64("vec_id", "rid"), F.lit(1 << 20)) < int(share * (1 << 20))).select("rid", "v").limit(sample) if share < 1 else rows.select("rid", "v")
    x = _matrix(picked.orderBy("rid").toArrow().column(1).combine_chunks(), d)
    return Codebooks.fit(_directions(x)[0] if len(x) else np.ones((1, d)), **settings)


def encoded(rows: DataFrame, d: int, books: Codebooks, block: int = CODE_BLOCK) -> DataFrame:
    """(block, rids, codes, scale): every row's codes and the factor that its two norms give, in blocks of about ``block`` rows."""
    held = rows.sparkSession.sparkContext.broadcast(books.words)  # BOOKS * WORDS * dimension numbers

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = Codebooks(held.value)
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                rids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                unit, norm = _directions(_matrix(part.column(1), d))
                codes = np.concatenate([own.encode(unit[i : i + 512]) for i in range(0, len(unit), 512)])
                whole = np.sqrt((own.sums(codes) ** 2).sum(1))
                scale = (norm / np.maximum(whole, 1e-6)).astype(np.float64)
                yield pa.RecordBatch.from_pydict({"block": [int(rids[0])], "rids": [rids.tobytes()], "codes": [codes.tobytes()], "scale": [scale.tobytes()]})

    return rows.select("rid", "v").mapInArrow(run, "block long, rids binary, codes binary, scale binary")


def shortlists(queries: DataFrame, index: DataFrame, d: int, books: Codebooks, shortlist: int, n_rows: int, n_queries: int) -> DataFrame:
    """(q_rid, c_rid): each query's best candidates by table scores. Blocks of queries meet stripes of the index; a pair of them is a group of bounded size."""
    nq, stripes = max(1, -(-n_queries // QUERY_BLOCK)), max(1, -(-n_rows // STRIPE))
    held = index.sparkSession.sparkContext.broadcast(books.words)
    q = queries.select("rid", "v").withColumn("qb", F.pmod(F.xxhash64("rid"), F.lit(nq)).cast("int")).withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    c = index.withColumn("stripe", F.pmod(F.xxhash64("block"), F.lit(stripes)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))

    def run(left, right):
        import pyarrow as pa

        own, n, m = Codebooks(held.value), left.num_rows, len(held.value)
        best, score = np.zeros((n, 0), np.int64), np.zeros((n, 0), np.float32)
        if n and right.num_rows:
            # Scores of one query keep their order when the query is scaled.
            tables, q_rids = own.tables(_directions(_matrix(left.column("v").combine_chunks(), d))[0]), left.column("rid").to_numpy()
            for rids, codes, scale in zip(*(right.column(k).to_pylist() for k in ("rids", "codes", "scale")), strict=True):
                rids = np.frombuffer(rids, np.int64)
                more = looked_up(tables, np.frombuffer(codes, np.uint8).reshape(-1, m), np.frombuffer(scale, np.float64))
                more[q_rids[:, None] == rids] = -np.inf
                best, score = np.concatenate([best, np.broadcast_to(rids, (n, len(rids)))], axis=1), np.concatenate([score, more], axis=1)
                if score.shape[1] > shortlist:
                    keep = np.argpartition(-score, shortlist - 1, axis=1)[:, :shortlist]
                    best, score = np.take_along_axis(best, keep, 1), np.take_along_axis(score, keep, 1)
            found = score > -np.inf
            out = {"q_rid": np.repeat(q_rids, found.sum(1)), "c_rid": best[found], "near": score[found].astype(np.float64)}
        else:
            out = {"q_rid": np.zeros(0, np.int64), "c_rid": np.zeros(0, np.int64), "near": np.zeros(0)}
        return pa.table(out)

    pairs = q.groupBy("qb", "stripe").cogroup(c.groupBy("qb", "stripe")).applyInArrow(run, "q_rid long, c_rid long, near double")
    if stripes == 1:
        return pairs.select("q_rid", "c_rid")
    w = Window.partitionBy("q_rid").orderBy(F.desc("near"), "c_rid")
    return pairs.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= shortlist).select("q_rid", "c_rid")


def neighbours(vectors: DataFrame, is_query, k: int = 20, shortlist: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE, **settings) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found by inner product of each row for which ``is_query`` (a condition on vec_id) holds."""
    rows, d = usable(vectors, id_col, vec_col)
    spark, n = rows.sparkSession, rows.count()
    queries = rows.filter(is_query)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    books = fit_codebooks(rows, d, sample, **settings)
    index = materialize(encoded(rows, d, books), "codes")
    pairs = materialize(shortlists(queries, index, d, books, shortlist, n, queries.count()), "shortlists")
    discard(index)
    q = queries.select(F.col("rid").alias("q_rid"), F.col("vec_id").alias("query_id"), F.col("v").alias("x"))
    c = rows.select(F.col("rid").alias("c_rid"), "vec_id", F.col("v").alias("y"))
    product = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    exact = pairs.join(c, "c_rid").join(q, "q_rid").select("q_rid", "query_id", "c_rid", "vec_id", product.alias("score"))
    w = Window.partitionBy("q_rid").orderBy(F.desc("score"), "vec_id", "c_rid")
    return exact.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Quality by a factorisation machine.

A text is a sparse vector: hashed words (log counts, unit length), indicators of
binned structure statistics, and indicators of binned metadata columns. The score
is sigmoid(bias + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairwise term is
computed in linear time as half of |sum v_i x_i|^2 - sum |v_i x_i|^2. Fitted by
Adagrad on about MAX_TRAIN labelled rows that are not held out (chosen by a hash of the id,
fewer if their features exceed MAX_TRAIN_BYTES).

Defined cases: null text is empty; empty texts have structure features alone and
get a score; texts are scored whole; a null metadata value has an indicator of
its own; equal texts with equal metadata score alike; without labelled rows every
score is 0.5; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiform.llm.common import held_out
from lexiform.llm.training import labelled_sample
from lexiform.llm.wordhash import NOT_ALNUM, SPACES, Block, blocks, distinct

DIM, RANK, MAX_TRAIN, THRESHOLD, EPOCHS, BATCH, RATE, DECAY, BINS = 1 << 16, 8, 8000, 0.7, 8, 100, 0.05, 1e-5, 16
#: Bytes of the sample's features on the driver at most.
MAX_TRAIN_BYTES = 1 << 27
#: Upper bounds of the bins of ratios; counts are binned by their binary logarithm.
EDGES = np.array([0.002, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.65, 0.8, 0.95])
_KIND = {name: np.zeros(256, bool) for name in ("upper", "digit", "punct", "line", "high", "stop", "mark", "bar")}
for _i in range(128):
    _c = chr(_i)
    for _name, _is in (("upper", _c.isupper()), ("digit", _c.isdigit()), ("punct", not _c.isalnum() and not _c.isspace() and _c.isprintable()), ("line", _c == "\n"), ("stop", _c in ".,"), ("mark", _c in "!?"), ("bar", _c in "|#*$%&@<>{}[]\\~^=_/")):
        _KIND[_name][_i] = _is
_KIND["high"][128:] = True
STATISTICS = [*_KIND, "kinds", "most", "again", "lines_again", "word_length", "n_bytes", "n_words"]


def structure(block: Block) -> tuple[np.ndarray, tuple]:
    """Bins of STATISTICS, a row for each text; the distinct words."""
    size = np.diff(block.off)
    some = np.maximum(size, 1)
    ratios = [block.count(flags[block.raw]) / some for flags in _KIND.values()]
    starts, ends, first = block.words(NOT_ALNUM)
    n_words = np.diff(first)
    doc = np.repeat(np.arange(block.n), n_words)
    hashes = block.hashes(starts, ends)
    own, word, count = distinct(doc, hashes, block.n)
    many = np.maximum(n_words, 1)
    kinds = np.bincount(own, minlength=block.n) / many
    most = np.zeros(block.n)
    np.maximum.at(most, own, count)
    again = np.bincount(doc[1:][(hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])], minlength=block.n) / many if len(doc) > 1 else np.zeros(block.n)
    breaks = np.zeros(256, bool)
    breaks[10] = True
    l_starts, l_ends, l_first = block.words(breaks)
    lines = np.diff(l_first)
    l_own, _, _ = distinct(np.repeat(np.arange(block.n), lines), block.hashes(l_starts, l_ends), block.n)
    ratios += [kinds, most / many, again, 1 - np.bincount(l_own, minlength=block.n) / np.maximum(lines, 1)]
    bins = [np.searchsorted(EDGES, r, "right") for r in ratios]
    bins += [np.minimum(np.bincount(doc, weights=ends - starts, minlength=block.n) / many, BINS - 1).astype(int)]
    bins += [np.minimum(np.log2(1 + x).astype(int), BINS - 1) for x in (size, n_words)]
    return np.stack(bins, 1), (own, word, count)


def features(block: Block, metadata: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices and values of all texts, and the first of each text. metadata: name and values of the block's texts."""
    bins, (own, word, count) = structure(block)
    parts = [bins + np.arange(bins.shape[1]) * BINS]
    for k, (_, values) in enumerate(metadata):
        known = np.array([v is not None for v in values])
        level = np.array([min(BINS - 2, int(np.log2(1 + abs(float(v or 0))))) for v in values])
        parts.append((np.where(known, level, BINS - 1) + (bins.shape[1] + k) * BINS)[:, None])
    fixed = np.concatenate(parts, 1)
    reserved, width = (bins.shape[1] + len(metadata)) * BINS, fixed.shape[1]
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(own, weights=value * value, minlength=block.n))
    n = np.bincount(own, minlength=block.n) + width
    first = np.concatenate([[0], np.cumsum(n)])
    index, x = np.empty(first[-1], np.int64), np.empty(first[-1], np.float32)
    at = first[:-1, None] + np.arange(width)
    index[at], x[at] = fixed, 1 / np.sqrt(width)
    rest = np.ones(first[-1], bool)
    rest[at] = False
    index[rest] = reserved + (word % np.uint64(DIM - reserved)).astype(np.int64)
    x[rest] = value / np.maximum(norm[own], 1e-9)
    return index, x, first


class Machine:
    def __init__(self, seed: int = 1):
        self.bias, self.w, self.v = 0.0, np.zeros(DIM, np.float32), np.random.default_rng(seed).normal(0, 0.05, (DIM, RANK)).astype(np.float32)

    def score(self, index: np.ndarray, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits, and what the gradient needs: v_i x_i and their sums."""
        vx = self.v[index] * x[:, None]
        total = np.add.reduceat(vx, first[:-1])
        squares = np.add.reduceat(np.einsum("ij,ij->i", vx, vx), first[:-1])
        linear = np.add.reduceat(self.w[index] * x, first[:-1])
        return self.bias + linear + 0.5 * ((total * total).sum(1) - squares), vx, total

    def fit(self, index: np.ndarray, x: np.ndarray, first: np.ndarray, labels: np.ndarray, seed: int = 1) -> Machine:
        rng, gw, gv, gb = np.random.default_rng(seed), np.full(DIM, 1e-3, np.float32), np.full((DIM, RANK), 1e-3, np.float32), 1e-3
        for _ in range(EPOCHS):
            order = rng.permutation(len(labels))
            for some in np.array_split(order, max(1, len(order) // BATCH)):
                n = first[some + 1] - first[some]
                ptr = np.concatenate([[0], np.cumsum(n)])
                at = np.repeat(first[some] - ptr[:-1], n) + np.arange(ptr[-1])
                own, val = index[at], x[at]
                z, vx, total = self.score(own, val, ptr)
                g = ((1 / (1 + np.exp(-z)) - labels[some]) / len(some)).astype(np.float32)
                each = np.repeat(g, n) * val
                used, back = np.unique(own, return_inverse=True)
                dw = np.bincount(back, weights=each).astype(np.float32) + DECAY * self.w[used]
                push = np.repeat(total, n, axis=0) - vx
                dv = np.stack([np.bincount(back, weights=each * push[:, f]) for f in range(RANK)], 1).astype(np.float32) + DECAY * self.v[used]
                gw[used] += dw * dw
                gv[used] += dv * dv
                gb += g.sum() ** 2
                self.w[used] -= RATE * dw / np.sqrt(gw[used])
                self.v[used] -= RATE * dv / np.sqrt(gv[used])
                self.bias -= RATE * g.sum() / np.sqrt(gb)
        return self


def train(docs: DataFrame, labels: DataFrame, metadata: tuple[str, ...], label: str = "quality", bound: int = MAX_TRAIN) -> Machine:
    """Features are made on executors; those of the bounded sample come to the driver."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, y, meta = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [(c, batch.column(c).to_pylist()) for c in metadata]
            for at, block in blocks(batch.column(2)):
                index, x, first = features(block, [(c, v[at : at + block.n]) for c, v in meta])
                rows = [(ids[at + i], y[at + i], index[first[i] : first[i + 1]].astype(np.int32).tobytes(), x[first[i] : first[i + 1]].tobytes()) for i in range(block.n)]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["doc_id", "label", "index", "x"])

    sample = labelled_sample(docs, labels, label, bound, ["text", *metadata]).selectExpr("doc_id", "label", "cast(text as string) as text", *(f"cast(`{c}` as double) as `{c}`" for c in metadata))
    rows, held = [], 0
    for row in sample.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id", F.xxhash64("text")).mapInArrow(run, "doc_id long, label int, index binary, x binary").toLocalIterator():
        rows.append(row)
        held += len(row[2]) + len(row[3])
        if held >= MAX_TRAIN_BYTES:
            break
    machine = Machine()
    if not rows:
        machine.v[:] = 0
        return machine
    index = [np.frombuffer(r[2], np.int32) for r in rows]
    first = np.concatenate([[0], np.cumsum([len(i) for i in index])])
    return machine.fit(np.concatenate(index).astype(np.int64), np.concatenate([np.frombuffer(r[3], np.float32) for r in rows]), first, np.array([r[1] for r in rows], np.float32))


def score_documents(docs: DataFrame, machine: Machine, metadata: tuple[str, ...]) -> DataFrame:
    """doc_id and score of every whole text. No shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(machine)  # DIM * (RANK + 1) floats

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            meta, found = [(c, batch.column(c).to_pylist()) for c in metadata], [np.zeros(0)]
            for at, block in blocks(batch.column(1)):
                z = held.value.score(*features(block, [(c, v[at : at + block.n]) for c, v in meta]))[0]
                found.append(1 / (1 + np.exp(-z.astype(np.float64))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found))], ["doc_id", "score"])

    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text", *(f"cast(`{c}` as double) as `{c}`" for c in metadata))
    return rows.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, metadata: tuple[str, ...] = ("n_chars",), threshold: float = THRESHOLD) -> DataFrame:
    out = score_documents(docs, train(docs, labels, metadata), metadata)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

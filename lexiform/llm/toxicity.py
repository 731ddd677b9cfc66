"""Toxicity by multiple-instance learning.

A document is a bag of sentences, which end at full stops, exclamation marks, question marks
and line breaks. Each sentence has a linear score over hashed
words and word beginnings; a document's probability is their noisy-or,
1 - prod(1 - p). Weights are fitted to document labels through the noisy-or, on
about MAX_TRAIN labelled rows that are not held out (chosen by a hash of the id, fewer if their
features exceed MAX_TRAIN_BYTES), and then locate the offending sentences of any document.

Defined cases: null and empty texts and texts without words have no sentences and
score 0; a text without sentence ends is one sentence; texts are scored whole;
equal texts score alike; labels that are null or conflicting count as absent or as 1;
without labelled rows all scores are those of the prior bias; an empty table gives
no rows; other columns are ignored (kept by ``drop_toxic``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiform.llm.common import held_out, iterator_udf
from lexiform.llm.training import labelled_sample
from lexiform.llm.wordhash import NOT_ALNUM, Block, blocks

DIM, MAX_TRAIN, THRESHOLD, EPOCHS, BATCH, RATE, PRIOR, DECAY, START = 1 << 20, 10000, 0.3, 20, 200, 0.3, -8.5, 0.02, 1.0
#: Bytes of the sample's features on the driver at most.
MAX_TRAIN_BYTES = 1 << 27
#: Bytes of the word beginnings that are features beside whole words.
STEMS = (3, 5, 7)
_ENDS = np.zeros(256, bool)
_ENDS[[10, 33, 46, 63]] = True


def bags(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of all sentences, first feature of each sentence, first sentence of each text, sentences' [start, end) in bytes."""
    starts, ends, first = block.words(NOT_ALNUM)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(block.n + 1, np.int64), np.zeros((0, 2), np.int64)
    doc = np.repeat(np.arange(block.n), np.diff(first))
    sentence = np.cumsum(_ENDS[block.raw])[starts] + doc
    begin = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]]))
    each, part = 1 + len(STEMS), DIM // 4  # STEMS and whole words
    features = np.empty(each * len(starts), np.int64)
    for k, length in enumerate((None, *STEMS)):
        stop = ends if length is None else np.minimum(starts + length, ends)
        features[k::each] = (block.hashes(starts, stop) & np.uint64(part - 1)).astype(np.int64) + k * part
    spans = np.stack([starts[begin], ends[np.concatenate([begin[1:], [len(starts)]]) - 1]], 1)
    # A word that repeats the one before it adds nothing; the first word of an instance always counts.
    new = np.concatenate([[True], features[each::each] != features[:-each:each]])
    new[begin] = True
    features = features.reshape(-1, each)[new].ravel()
    return features, (np.cumsum(new)[begin] - 1) * each, np.searchsorted(begin, first), spans


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0, -z))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def fit(features: np.ndarray, sentences: np.ndarray, docs: np.ndarray, labels: np.ndarray, seed: int = 1) -> np.ndarray:
    """Weights (DIM and the bias) that maximise the noisy-or likelihood. docs: first sentence of each bag, none empty."""
    w, squares = np.zeros(DIM + 1), np.full(DIM + 1, float(START))
    w[DIM], rng = PRIOR, np.random.default_rng(seed)
    sentences, docs = np.append(sentences, len(features)), np.append(docs, len(sentences))
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for some in np.array_split(order, max(1, len(order) // BATCH, min(32, len(order) // 8))):
            own = np.concatenate([np.arange(docs[i], docs[i + 1]) for i in some])
            sizes = sentences[own + 1] - sentences[own]
            at = np.repeat(sentences[own] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            idx, head = features[at], np.concatenate([[0], np.cumsum(sizes)[:-1]])
            z = w[DIM] + np.add.reduceat(w[idx], head)
            bag = docs[some + 1] - docs[some]
            log_q = -np.add.reduceat(_softplus(z), np.concatenate([[0], np.cumsum(bag)[:-1]]))
            q = np.exp(log_q)
            pull = np.where(labels[some] == 1, -q / np.maximum(1 - q, 1e-9), 1.0)
            g = np.repeat(pull, bag) * _sigmoid(z)
            grad = np.bincount(idx, weights=np.repeat(g, sizes), minlength=DIM + 1)
            grad[DIM] = g.sum()
            grad[:DIM] += DECAY * w[:DIM]
            squares += grad * grad
            w -= RATE * grad / np.sqrt(squares)
    return w.astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = MAX_TRAIN) -> np.ndarray:
    """Features are made on executors; those of the bounded sample come to the driver."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, y = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, block in blocks(batch.column(2)):
                features, sentences, first, _ = bags(block)
                sentences = np.append(sentences, len(features))
                rows = []
                for i in range(block.n):
                    own = sentences[first[i] : first[i + 1] + 1]
                    rows.append((ids[at + i], y[at + i], features[own[0] : own[-1]].astype(np.int32).tobytes(), np.diff(own).astype(np.int32).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["doc_id", "label", "features", "sizes"])

    sample = labelled_sample(docs, labels, label, bound, ["text"]).selectExpr("doc_id", "label", "cast(text as string) as text").orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id", F.xxhash64("text"))
    # One growing buffer: the sample's features are held once.
    features, sizes, first, y = bytearray(), bytearray(), [], []
    for row in sample.mapInArrow(run, "doc_id long, label int, features binary, sizes binary").toLocalIterator():
        if len(row[3]):
            first.append(len(sizes) // 4)
            y.append(row[1])
            features += row[2]
            sizes += row[3]
            if len(features) + len(sizes) >= MAX_TRAIN_BYTES:
                break
    if not y:
        w = np.zeros(DIM + 1, np.float32)
        w[DIM] = PRIOR
        return w
    ends = np.cumsum(np.frombuffer(sizes, np.int32), dtype=np.int64)
    return fit(np.frombuffer(features, np.int32), np.concatenate([[0], ends[:-1]]), np.array(first), np.array(y))


def score_block(block: Block, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Score of each text, probability and span of each sentence, first sentence of each text."""
    features, sentences, first, spans = bags(block)
    score = np.zeros(block.n)
    if not len(sentences):
        return score, np.zeros(0), spans, first
    z = w[DIM] + np.add.reduceat(w[features].astype(np.float64), sentences)
    held = np.flatnonzero(np.diff(first))
    score[held] = -np.expm1(-np.add.reduceat(_softplus(z), first[held]))
    return score, _sigmoid(z), spans, first


def score_documents(docs: DataFrame, w: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, offending: [start, end) in code points of the sentences whose own probability reaches the threshold. No shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(w)  # DIM + 1 floats

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            scores, found = [], []
            for _, block in blocks(batch.column(1)):
                score, p, spans, first = score_block(block, held.value)
                scores.append(score)
                points = np.concatenate([[0], np.cumsum((block.raw & 0xC0) != 0x80)])
                own = [[] for _ in range(block.n)]
                for k in np.flatnonzero(p >= threshold):
                    i = int(np.searchsorted(first, k, "right")) - 1
                    own[i].append({"start": int(points[spans[k, 0]] - points[block.off[i]]), "end": int(points[spans[k, 1]] - points[block.off[i]])})
                found += own
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([*scores, np.zeros(0)])), pa.array(found, kind)], ["doc_id", "score", "offending"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(run, "doc_id long, score double, offending array<struct<start:long,end:long>>")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    out = score_documents(docs, train(docs, labels), threshold)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.size("offending").alias("n_offending"), "offending")


def drop_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score threshold or more; all columns, no shuffle."""
    held = spark.sparkContext.broadcast(train(docs, labels))

    def score(texts):
        import pyarrow as pa

        for text in texts:
            yield pa.array(np.concatenate([*(score_block(block, held.value)[0] for _, block in blocks(text)), np.zeros(0)]))

    return docs.filter(iterator_udf(score, "double")(F.col("text").cast("string")) < threshold)

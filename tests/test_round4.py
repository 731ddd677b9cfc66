"""Faults that a reviewer found at size: what one task, the driver or the disk takes may not grow with the tables."""

import math

import numpy as np
from pyspark.sql import functions as F

from lexiform.operators import bounded as B
from lexiform.operators import encoders as E
from lexiform.operators import losses as L
from lexiform.operators import ranking as R
from lexiform.plans import tables as T


def test_files_grow_in_number_with_rows(spark, monkeypatch):
    monkeypatch.setattr(T, "FILE_ROWS", 100)
    path = T._written(spark.range(2000).select(F.col("id").cast("string").alias("a"), F.lit("x").alias("b")), "rows", ["a"])
    files = spark.read.csv(path, sep="\t", header=True).select("a", F.input_file_name().alias("file"))
    assert files.count() == 2000 and files.select("file").distinct().count() == 20  # before: 4, whatever the number of rows


def test_scores_of_a_task_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(L, "SCORES", 16)
    rows = spark.createDataFrame([(i, i % 3, [float(i % 5), 1.0]) for i in range(64)], "row long, fact_id long, v array<double>")
    z = L.logits(rows, rows, batch=4)
    assert z.count() == 64 * 4 and z.rdd.getNumPartitions() >= 16  # before: batches were joined by the bytes of their vectors


def test_encoders_equal_plain_formulas():
    """Products by byte, few GELUs and few texts at a time change no vector."""
    ids, enc = E.byte_matrix(["aba", "", "zz top of the hill"], 24), E.ConvEncoder(p={f"c{w}": np.full(48, -3.0) for w in (3, 5)})
    x, mask, pooled = enc.token_features(ids), (ids > 0)[..., None], []
    gelu = np.vectorize(lambda v: 0.5 * v * (1 + math.erf(v / math.sqrt(2))))
    for w in enc.widths:
        padded = np.pad(x, ((0, 0), (w // 2, w // 2), (0, 0)))
        y = gelu(sum(padded[:, j : j + 24] @ enc.p[f"k{w}"][j] for j in range(w)) + enc.p[f"c{w}"])
        pooled.append(np.where(mask.any(1), np.where(mask, y, -np.inf).max(1), 0))
    assert np.allclose(enc(ids), E.unit(gelu(np.concatenate(pooled, 1) @ enc.p["a"]) @ enc.p["b"]), atol=1e-6)
    assert E.AttentionEncoder().together * 256**2 * 4 * 8 <= 16 << 20  # bytes of its scores; before: those of 128 texts


def test_copies_are_one_candidate(spark, monkeypatch):
    """Three vectors, each many times, among queries and candidates: ranks by hand, and each distinct pair is met once."""
    met = []
    monkeypatch.setattr(B, "_grid", lambda asked, rows, *a, grid=B._grid: met.append((asked.count(), rows.count())) or grid(asked, rows, *a))
    vec = [[1.0, 0.0], [0.8, 0.6], [0.0, 1.0]]
    rows = [(f"{i:03d}", str(i % 10), vec[i % 3]) for i in range(90)]
    df = spark.createDataFrame(rows, "form_id string, fact_id string, dense array<double>")
    got = {r.form_id: r.ranks[0] for r in B.first_match(df, df, [1.0]).collect()}
    for f, fact, v in rows:
        order = sorted((-round(float(np.dot(v, w)), 9), g, k) for g, k, w in rows if g != f)
        assert got[f] == next(n for n, (*_, k) in enumerate(order, 1) if k == fact)
    assert met == [(3, 3)]  # before: a row for each query and block


def test_members_are_counted_over_ranges(spark):
    members = [(c, f"{i:03d}") for c, n in (("a", 300), ("b", 7), ("c", 1)) for i in range(n)]
    asks = [("a", "000"), ("a", "150"), ("a", "1505"), ("a", "999"), ("b", "003"), ("c", "000"), ("none", "x")]
    before = B.members_before(spark.createDataFrame(asks, "class string, at string"), spark.createDataFrame(members, "class string, form string"))
    assert {(r["class"], r["at"]): r.before for r in before.collect()} == {(c, at): sum(k == c and f < at for k, f in members) for c, at in asks}


def test_joins_by_query_broadcast_nothing(spark):
    df = spark.createDataFrame([(f"{i}", str(i % 3), [float(i), 1.0]) for i in range(9)], "form_id string, fact_id string, dense array<double>")
    plan = B.first_match(df, df, [1.0])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan  # before: packed files of queries, bounds and thresholds were broadcast by their size


def test_vectors_of_texts_broadcast_no_grams(spark):
    df = spark.createDataFrame([("a", "one text"), ("b", "another")], "form_id string, text string")
    plan = R.with_vectors(df, R.idf([df]))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan  # before: grams, guessed by the size of the packed texts, stopped the driver
    assert R.with_vectors(df, R.idf([df])).count() == 2

"""Ranks of texts: vectors are made where they meet, and groups meet without a shuffle."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiform.operators import bounded as B
from lexiform.operators import grams as G
from lexiform.operators import ranking as R


def vectors(texts, corpus):
    """Unit vectors of texts by plain loops, idf over corpus."""
    grams = lambda x: Counter(t[k : k + n] for t in [f" {x.lower()} "] for n in range(2, 6) for k in range(len(t) - n + 1))
    df, out = Counter(g for x in corpus for g in grams(x)), []
    for x in texts:
        v = {g: n * (math.log((1 + len(corpus)) / (1 + df[g])) + 1) for g, n in grams(x).items()}
        norm = math.sqrt(sum(w * w for w in v.values()))
        out.append({g: w / norm for g, w in v.items()})
    return out


def ranks_by_hand(q, c, vq, vc, blend):
    out = {}
    for (f, fact, _, d), v in zip(q, vq, strict=True):
        score = {g: round((1 - blend) * sum(w * u.get(k, 0.0) for k, w in v.items()) + blend * float(np.dot(d, e)), 9) for (g, _, _, e), u in zip(c, vc, strict=True) if g != f}
        order, facts = sorted(score, key=lambda g: (-score[g], g)), {g: h for g, h, *_ in c}
        out[f] = next((k for k, g in enumerate(order, 1) if facts[g] == fact), None)
    return out


def some_rows(n, seed, facts):
    rng = np.random.default_rng(seed)
    words = ["der", "Rang", "the", "rank", "été", "x", "nnnn", "ÉTÉ", "of", "und", "😀a"]
    text = lambda: " ".join(rng.choice(words, rng.integers(0, 9)))
    rows = [(f"{i:03d}", str(rng.integers(0, facts) if i % 3 else 0), text(), [float(x) for x in np.round(rng.normal(size=3), 2)]) for i in range(n)]
    return [(f, k, rows[i - 1][2] if i % 7 == 3 else t, rows[i - 1][3] if i % 7 == 3 else d) for i, (f, k, t, d) in enumerate(rows)]


@pytest.mark.parametrize(("blend", "group"), [(0.0, 8 << 20), (0.0, 1500), (0.7, 1500)])
def test_ranks_of_texts_over_groups(spark, monkeypatch, blend, group):
    """One frequent fact, copies, empty texts, characters of two and four bytes; facts, queries and candidates in one and in several groups. Groups are met without a shuffle."""
    plans = []
    monkeypatch.setattr(B, "GROUP", group)
    monkeypatch.setattr(B, "_grid", lambda *a, grid=B._grid: plans.append((df := grid(*a))._jdf.queryExecution().executedPlan().toString()) or df)
    rows = some_rows(70, 5, 9)
    df = spark.createDataFrame(rows, "form_id string, fact_id string, text string, dense array<double>")
    corpus = [r[2] for r in rows]
    v = vectors(corpus, corpus * 2)
    got = {r.form_id: r["rank"] for r in R.text_ranks(df, df, blend).collect()}
    assert got == ranks_by_hand(rows, rows, v, v, blend)
    assert len(plans) == 1 and "CartesianProduct" in plans[0] and "Exchange" not in plans[0]  # before: each group was sent to all groups of the other side


def test_facts_of_many_forms_are_cut(spark, monkeypatch):
    """Facts that meet by matrix products give the same best positives as pairs one by one."""
    monkeypatch.setattr(B, "GROUP", 1 << 14)
    monkeypatch.setattr(B, "QUERY_BLOCK", 50)
    monkeypatch.setattr(B, "BLOCK", 30)
    rng = np.random.default_rng(2)
    rows = [(f"{i:04d}", str(i % 2), [float(x) for x in np.round(rng.normal(size=4), 2)]) for i in range(600)]
    df = spark.createDataFrame(rows, "form_id string, fact_id string, dense array<float>")
    got = {r.form_id: r.ranks[0] for r in B.first_match(df, df, [1.0]).collect()}
    x = np.array([v for *_, v in rows], np.float32).astype(np.float64)
    score, forms = np.round(x @ x.T, 9), np.arange(600)
    for i in range(600):
        order = [j for j in np.lexsort((forms, -score[i])) if j != i]
        assert got[f"{i:04d}"] == next(k for k, j in enumerate(order, 1) if j % 2 == i % 2)


def test_grams_are_counted_inside_tasks(spark):
    texts = ["the ranks", "the", "", "Übung", "the ranks"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.g: r.idf for r in G.gram_idf([df, df.limit(1)]).collect()}
    seen = [np.unique(G.hashed(t)[0]) for t in [*texts, texts[0]]]
    counts = Counter(int(g) for x in seen for g in x)
    assert got == pytest.approx({g: math.log(7 / (1 + n)) + 1 for g, n in counts.items()})
    assert G.gram_idf([df.filter(F.lit(False))]).count() == 0


def test_tasks_hold_texts(spark, monkeypatch):
    """The three tasks of method_comparison give texts to the ranks, not a row or an entry for each gram of each vector."""
    from lexiform.plans import retrieval

    class Seen(Exception):
        pass

    def seen(q, c, *a, weights, **k):
        assert "text" in q.columns and "g" not in q.columns and "g" not in c.columns  # before: gram arrays of each vector in each task
        sets = {r.ws: r.n for r in weights.groupBy("ws").agg(F.count("*").alias("n")).collect()}
        assert set(sets) == {1, 2, 3} and min(sets.values()) > 10
        assert {tuple(r) for r in c.select("ws", F.element_at("serves", 1)).distinct().collect()} == {(t, t) for t in (1, 2, 3)}
        raise Seen

    monkeypatch.setattr(retrieval, "first_match", seen)
    with pytest.raises(Seen):
        retrieval.method_comparison(spark, "/root/testdata/sf0.001")

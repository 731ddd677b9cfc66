"""Encoders with given weights, numeric modes, students, caches, checkpoints and the bootstrap, against plain formulas."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiform.operators import classes as C
from lexiform.operators import encoders as E
from lexiform.operators import features as X
from lexiform.operators import metrics as M
from lexiform.operators import ranking as R
from lexiform.operators import resample as RS
from lexiform.operators import splits as S


def gelu(x):
    return 0.5 * x * (1 + math.erf(x / math.sqrt(2)))


def test_gelu_is_exact_enough():
    x = np.linspace(-6, 6, 241)
    assert np.allclose(E.gelu(x), [gelu(v) for v in x], atol=1e-6)


def test_conv_encoder_with_given_weights():
    """Two bytes, one channel: the sums are worked out by hand."""
    e = np.zeros((E.VOCABULARY, 1))
    e[ord("a") + 1], e[ord("b") + 1] = 1.0, 2.0
    kernel = np.array([0.5, 1.0, -1.0]).reshape(3, 1, 1)
    enc = E.ConvEncoder(hidden=1, out=2, widths=(3,), p={"e": e, "k3": kernel, "c3": [0.25], "a": [[2.0]], "a_bias": [0.5], "b": [[1.0, -3.0]], "b_bias": [0.0, 1.0]})
    top = max(gelu(1.0 * 1.0 + -1.0 * 2.0 + 0.25), gelu(0.5 * 1.0 + 1.0 * 2.0 + 0.25))
    h = gelu(2 * top + 0.5)
    want = np.array([h, 1 - 3 * h])
    assert np.allclose(enc(E.byte_matrix(["ab"], 6))[0], want / np.linalg.norm(want), atol=1e-6)
    with pytest.raises(ValueError):
        E.ConvEncoder(p={"no such": 1})


def test_pad_rows_and_lengths_do_not_matter():
    for enc in (E.ConvEncoder(), E.AttentionEncoder(), E.PooledEncoder(E.AttentionEncoder(), "mean"), E.PooledEncoder(E.AttentionEncoder(), "cls")):
        a, b = enc(E.byte_matrix(["BRAF V600E", "TP53"], 15)), enc(E.byte_matrix(["BRAF V600E", "TP53", ""], 35))
        assert np.allclose(a, b[:2], atol=1e-5) and np.allclose(np.linalg.norm(a, axis=1), 1) and np.isfinite(b).all()
    states = E.AttentionEncoder().token_features(E.byte_matrix(["ab"], 5))
    assert not states[0, 2:].any() and np.allclose(E.pooled_states(states, np.array([[True, True, False, False, False]]), "cls"), states[:, 0])
    with pytest.raises(ValueError):
        E.pooled_states(states, states[..., 0] > 0, "max")


def test_norm_scales_are_used():
    p = {"scale": np.zeros(64), "shift": np.ones(64)}
    out = E.AttentionEncoder(p=p)(E.byte_matrix(["x", "yz"], 4))
    assert np.allclose(out[0], out[1])  # every state is the shift


@pytest.mark.parametrize("mode", ["explicit", "sinusoidal", "xval"])
def test_numeric_encoder_modes(mode):
    values, present = np.array([[0.25, 0.5], [0.75, 9.0]]), np.array([[1.0, 1.0], [1.0, 0.0]])
    n = E.NumericEncoder(2, 3, mode, depth=2)
    rows = []
    for v, m in zip(values, present, strict=True):
        if mode == "explicit":
            f = [*v, *m]
        elif mode == "xval":
            f = [sum(v[i] * m[i] * n.p["fields"][i, k] for i in range(2)) for k in range(3)]
        else:
            f = [g(v[i] * 2**k * math.pi) * m[i] for g in (math.sin, math.cos) for i in range(2) for k in range(2)] + list(m)
        rows.append(f)
    hidden = np.vectorize(gelu)(np.array(rows) @ n.p["a"] + n.p["a_bias"])
    assert np.allclose(n(values, present), hidden @ n.p["b"] + n.p["b_bias"], atol=1e-5)
    with pytest.raises(ValueError):
        E.NumericEncoder(1, 1, "other")


def test_student_over_rows(spark):
    student = E.Student(E.MeanEncoder(), E.NumericEncoder(1, 64, "xval"), 0.5, {"kind": (np.ones((64, 2)), np.array([0.0, 1.0]))}, {"size": (np.ones((64, 1)), np.zeros(1))})
    rows = spark.createDataFrame([("abc", [(0.5, 1.0)]), ("de", [(0.0, 0.0)])], "text string, numeric array<struct<value:double,present:double>>")
    got = {r.text: r for r in E.encode_student(rows, student).collect()}
    for text, v, m in (("abc", 0.5, 1.0), ("de", 0.0, 0.0)):
        x = student.text(E.byte_matrix([text]))[0] * 0.5 + student.numeric(np.array([[v]]), np.array([[m]]))[0]
        x /= np.linalg.norm(x)
        assert np.allclose(got[text].dense, x) and np.allclose(got[text].logits_kind, [x.sum(), x.sum() + 1]) and np.allclose(got[text].logits_size, [x.sum()])


def test_attention_teacher_matches_numpy(spark):
    forms = spark.createDataFrame([(0, "ab", "bca")], "pair int, l string, r string")
    enc = E.AttentionEncoder()
    both = E.token_features(E.token_features(forms, enc, 8, "l", "source"), enc, 8, "r", "target")
    got = {(r.i, r.j): r.p for r in X.attention_probs(both.select("pair", "source", "target"), 2.0).collect()}
    s, t = enc.token_features(E.byte_matrix(["ab"], 8))[0, :2], enc.token_features(E.byte_matrix(["bca"], 8))[0, :3]
    z = s @ t.T / (math.sqrt(64) * 2.0)
    want = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    assert len(got) == 6 and all(got[i, j] == pytest.approx(want[i, j]) for i in range(2) for j in range(3))


def test_anchor_is_the_first_form(spark):
    forms = spark.createDataFrame([("f", f"f::{i}", i, t) for i, t in enumerate("abc")] + [("g", "g::0", 0, "z")], "fact_id string, form_id string, pos int, text string")
    assert sorted((r.left_text, r.right_text) for r in X.anchor_pairs(forms).collect()) == [("a", "b"), ("a", "c")]


def test_cache_is_read_through(spark, tmp_path):
    path, calls = str(tmp_path / "cache"), E.MeanEncoder()
    first = {r.text: r.dense for r in E.cached_encode(spark.createDataFrame([("a",), ("b",), ("a",)], "text string"), calls, path, "m").collect()}
    again = E.cached_encode(spark.createDataFrame([("b",), ("c",)], "text string"), calls, path, "m").collect()
    assert {r.text for r in again} == {"b", "c"} and next(r.dense for r in again if r.text == "b") == first["b"]
    assert spark.read.parquet(path).count() == 3 and np.allclose(first["a"], calls(E.byte_matrix(["a"]))[0])


def test_cache_rows_do_not_multiply(spark, tmp_path):
    """Two models and interleaved, repeated runs, null texts: one row a text and model; a run reads and writes its own buckets only."""
    path, enc = str(tmp_path / "cache"), E.MeanEncoder()
    frame = lambda *t: spark.createDataFrame([(x,) for x in t], "text string")
    a, b = frame("a", "b", None, "a"), frame("b", "c", None)
    for name in ("m", "n", "m"):
        for df in (a, b, a):
            rows = E.cached_encode(df, enc, path, name).collect()
            assert len(rows) == df.count() and all(r.dense is not None for r in rows)
    held = spark.read.parquet(path)
    assert held.count() == 8 and held.groupBy("model", "text").count().filter("count > 1").isEmpty()
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    E.cached_encode(frame("zz"), enc, path, "m").collect()
    after = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    new = {p.parent for p in set(after) - set(before)}
    assert len(new) == 1 and all(after.get(p) == t for p, t in before.items() if p.parent not in new)


def test_vocabulary_and_labels_of_a_million_values(spark):
    """Numbers by ranges instead of one window a field; labels by joins, with a value that a third of the rows hold."""
    n = 1_000_000
    rows = spark.range(n).select("id", F.create_map(F.lit("k"), F.lpad(F.col("id").cast("string"), 7, "0"), F.lit("few"), (F.col("id") % 3).cast("string")).alias("attrs"))
    vocabulary = X.vocabularies(rows, ["k", "few", "none"]).cache()
    assert vocabulary.count() == n + 3 and vocabulary.filter("field = 'k' and cast(value as int) <> index").isEmpty()
    assert sorted((r.value, r["index"]) for r in vocabulary.filter("field = 'few'").collect()) == [("0", 0), ("1", 1), ("2", 2)]
    asked = spark.range(30_000).select("id", F.create_map(F.lit("k"), F.when(F.col("id") % 3 == 0, "0000007").when(F.col("id") % 3 == 1, F.lpad((F.col("id") * 31).cast("string"), 7, "0")), F.lit("few"), F.lit("9")).alias("attrs"))
    got = X.attribute_labels(asked, vocabulary, ["k", "few"])
    want = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id") * 31).otherwise(-1)
    assert got.count() == 30_000 and got.filter(want != F.col("label_k")).isEmpty() and got.filter("label_few <> -1").isEmpty()
    vocabulary.unpersist()


def test_pairs_of_blocks_cover_hot_facts(spark):
    """Extremes equal those over all pairs; no group of a fact of 100,000 forms is larger than two blocks."""
    rng = np.random.default_rng(1)
    rows = [("hot" if i % 3 else str(i % 40), f"{i:04d}", E.unit(rng.normal(size=3)).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "fact_id string, form_id string, dense array<double>")
    w = M.within_distances(df).groupBy("fact_id").agg(F.count("*").alias("n"), F.avg("distance").alias("m"), F.min("distance").alias("a"), F.max("distance").alias("b")).collect()
    for size in (7, 2048):
        got = {r.fact_id: r for r in M.within_extremes(df, size).collect()}
        assert len(got) == len(w) and all((got[r.fact_id].pairs, got[r.fact_id].mean, got[r.fact_id].least, got[r.fact_id].most) == pytest.approx((r.n, r.m, r.a, r.b), abs=1e-9) for r in w)
    many = spark.range(100_000).select(F.lit("f").alias("fact_id"), F.col("id").cast("string").alias("form_id"), F.array(F.lit(1.0)).alias("dense"))
    sizes = M.block_pairs(many).groupBy("group").count().agg(F.max("count").alias("most"), F.count("*").alias("groups")).first()
    assert sizes.most <= 2.3 * M.BLOCK and sizes.groups == 49 * 50 / 2


def test_training_over_workers_and_checkpoints(spark, tmp_path):
    pairs = spark.createDataFrame([(f"f{i}", f"gene {i} alpha", f"{i} alpha!") for i in range(200)], "fact_id string, left_text string, right_text string")
    history = []
    model = E.fit_student(pairs, epochs=3, batch=32, share=100, history=history)
    assert [h["pairs"] for h in history] == [200] * 3 and history[2]["loss"] < history[0]["loss"]
    E.save_student(spark, model, str(tmp_path / "model"), history)
    again, told = E.load_student(spark, str(tmp_path / "model"))
    ids = E.byte_matrix(["gene 3 alpha"])
    assert np.allclose(again(ids), model(ids)) and told == history
    empty = E.fit_student(pairs.limit(0), epochs=1)
    assert empty(ids).shape == (1, 64)


def test_gradient_of_the_loss():
    model, rng = E.MeanEncoder(hidden=4, out=3), np.random.default_rng(0)
    left, right, fact = E.byte_matrix(["ab", "cd", "ce"], 4), E.byte_matrix(["ba", "dc", "x"], 4), np.array([0, 1, 1])
    _, grads = E.info_nce(model, left, right, fact, 0.5)
    for k in ("a", "b"):
        at = tuple(rng.integers(0, n) for n in model.p[k].shape)
        old = model.p[k][at]
        loss = []
        for d in (1e-5, -1e-5):
            model.p[k][at] = old + d
            loss.append(E.info_nce(model, left, right, fact, 0.5)[0])
        model.p[k][at] = old
        assert grads[k][at] == pytest.approx((loss[0] - loss[1]) / 2e-5, rel=1e-3, abs=1e-6)


def test_bootstrap_is_close_to_resampling(spark):
    rng = np.random.default_rng(2)
    ranks = [int(r) if r else None for r in rng.integers(0, 9, 400)]
    got = M.bootstrap(spark.createDataFrame([(i, r) for i, r in enumerate(ranks)], "id int, rank int"), 400).first()
    values = np.array([[r is not None and r <= 1, r is not None and r <= 5, 1 / r if r else 0.0] for r in ranks], float)
    means = np.array([values[rng.integers(0, 400, 400)].mean(0) for _ in range(2000)])
    want = np.percentile(means, [2.5, 97.5], axis=0)
    for k, name in enumerate(M.METRICS):
        assert got[f"{name}_ci_low"] == pytest.approx(want[0, k], abs=0.02) and got[f"{name}_ci_high"] == pytest.approx(want[1, k], abs=0.02)
    assert M.bootstrap(spark.createDataFrame([(0, 1)], "id int, rank int"), 20).first().bootstrap_resamples == 20
    assert M.bootstrap(spark.createDataFrame([], "id int, rank int"), 20).first().bootstrap_resamples == 0


def test_resamples_have_exactly_n_rows(spark):
    """45,000 distinct ranks: two levels of the tree. Sizes are exact, means and deviations those of a multinomial draw."""
    n = 45_000
    ranks = spark.range(n).select((F.col("id") + 1).alias("rank")).unionByName(spark.range(5000).select(F.lit(1).cast("long").alias("rank")))
    rows = ranks.select("rank", (F.col("rank") <= 1).cast("double").alias("top1"), (F.col("rank") > n / 2).cast("double").alias("late"))
    got = RS.resampled_sums(rows, "rank", ["top1", "late"], 40, 13).collect()
    assert len(got) == 40 and {r.n for r in got} == {n + 5000}
    for c, p in (("top1", 5001 / 50_000), ("late", 22_500 / 50_000)):
        sd = math.sqrt(50_000 * p * (1 - p))
        x = np.array([r[c] for r in got])
        assert abs(x.mean() - 50_000 * p) < 5 * sd / math.sqrt(40) and 0.6 * sd < x.std() < 1.5 * sd


def test_binomial_quantiles_match_exact_sums():
    for m, left, right in ((0, 1, 2), (1, 1, 1), (7, 3, 1), (60, 1, 50), (1000, 999, 1)):
        p, total, table = left / (left + right), 0.0, []
        for k in range(m + 1):
            total += math.comb(m, k) * p**k * (1 - p) ** (m - k)
            table.append(total)
        u = np.array([1e-13, 1e-9, 0.1, 0.5, 0.77, 0.999, 1 - 1e-12])
        want = [next((k for k, x in enumerate(table) if x >= c - 1e-15), m) for c in u]
        assert RS.quantiles(np.full(len(u), m), left, right, u).tolist() == want, m


def test_sampled_pairs_are_exact_in_number():
    for n, most in ((0, 5), (1, 5), (2, 5), (40, 50), (142, 10_000), (143, 10_000), (5000, 10_000)):
        pairs = M.pair_numbers(n, most, 13)
        assert len(set(pairs)) == len(pairs) == min(most, n * (n - 1) // 2) and all(0 <= i < j < n for i, j in pairs)


def test_linear_sums_equal_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(str(i % 5), f"{i:03d}", E.unit(rng.normal(size=3)).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "fact_id string, form_id string, dense array<double>")
    w = M.within_distances(df).groupBy("fact_id").agg(F.count("*").alias("n"), F.sum("distance").alias("s")).collect()
    sums = {r.fact_id: r for r in M.within_sums(df).collect()}
    assert all(sums[r.fact_id].pairs == r.n and sums[r.fact_id].distance == pytest.approx(r.s) for r in w)
    with pytest.raises(ValueError):
        M.invariance(df.filter("fact_id = '0'"), strict=True)


def test_canonical_ranks_match_a_sort_of_the_pool(spark):
    rng = np.random.default_rng(9)
    cands = [(f"c{i:03d}", rng.choice(["hot", "hot", "a", "b", None]), str(rng.integers(0, 12))) for i in rng.permutation(160)]
    queries = [(f"q{i:02d}", rng.choice(["hot", "a", "b", "none", None]), str(rng.integers(0, 14))) for i in range(60)]
    want = {}
    for f, k, r in queries:
        order = sorted(cands, key=lambda c: (not (k is not None and c[1] == k), c[0]))
        want[f] = next((n for n, c in enumerate(order, 1) if c[2] == r), None)
    frame = lambda rows: spark.createDataFrame([tuple(None if x is None else str(x) for x in r) for r in rows], "form_id string, k string, r string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert {r.form_id: r["rank"] for r in R.canonical_ranks(frame(queries), frame(cands), "k", "r").collect()} == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_checks_of_input(spark):
    classes = spark.createDataFrame([("f", [("a", "n")])], "fact_id string, forms array<struct<text:string,notation:string>>")
    assert C.validate(classes) is classes and C.as_forms(classes).count() == 1 and C.as_forms(C.as_forms(classes)).count() == 1
    with pytest.raises(ValueError):
        C.validate(classes.limit(0))
    with pytest.raises(ValueError):
        C.validate(classes.select("fact_id"))
    rows = spark.createDataFrame([({"a": "1"},)], "attrs map<string,string>")
    assert S.require_attr(rows, "a") is rows
    with pytest.raises(ValueError):
        S.require_attr(rows, "b")

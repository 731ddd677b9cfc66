"""Byte encoders in numpy, applied to Arrow batches, and a student that is fitted by a contrastive loss.

Deep-learning frameworks are not needed: the mean encoder's gradient is written out and
fitted on all pairs, by workers whose parameters are averaged after each epoch; the
convolutional, attention and numeric encoders run forward with the weights that they are given, or
with seeded ones.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiform.functions.text import shuffle_key
from lexiform.sources.shared import discard, materialize

VOCABULARY, MAX_LENGTH = 257, 256
#: Texts that an encoder takes at a time, unless it states a number.
TOGETHER = 128


def byte_matrix(texts: list[str | None], max_length: int = MAX_LENGTH) -> np.ndarray:
    """Byte ids plus one, zero-padded."""
    out = np.zeros((len(texts), max_length), np.int64)
    for row, text in zip(out, texts, strict=True):
        raw = np.frombuffer((text or "").encode()[:max_length], np.uint8)
        row[: len(raw)] = raw.astype(np.int64) + 1
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def erf(x: np.ndarray) -> np.ndarray:
    """The error function to about 1e-7, by a published Chebyshev fit of its complement. The ten coefficients of that fit."""
    x = np.asarray(x, float)
    t = np.abs(x)
    t *= 0.5
    t += 1
    np.divide(1, t, out=t)
    fit = np.full_like(t, 0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        fit *= t
        fit += c
    fit -= x * x
    np.exp(fit, out=fit)
    fit *= t
    np.subtract(1, fit, out=fit)
    return fit * np.sign(x)


def gelu(x: np.ndarray) -> np.ndarray:
    y = np.asarray(erf(x / np.sqrt(2)))
    y += 1
    y *= x
    y *= 0.5
    return y


def _weights(rng: np.random.Generator, *shape: int) -> np.ndarray:
    return rng.normal(0, 1 / np.sqrt(shape[0] if len(shape) < 3 else shape[0] * shape[1]), shape)


@dataclass
class MeanEncoder:
    """Embedding, masked mean over positions, one hidden layer, unit length."""

    hidden: int = 64
    out: int = 64
    seed: int = 13
    p: dict = field(default_factory=dict)

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        self.p = self.p or {"e": rng.normal(0, 0.3, (VOCABULARY, self.hidden)), "a": _weights(rng, self.hidden, self.hidden), "b": _weights(rng, self.hidden, self.out)}
        self.p["e"][0] = 0

    def parts(self, ids: np.ndarray):
        mask = (ids > 0)[..., None]
        mean = (self.p["e"][ids] * mask).sum(1) / np.maximum(mask.sum(1), 1)
        h = np.maximum(mean @ self.p["a"], 0)
        return mean, h, h @ self.p["b"]

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        return unit(self.parts(ids)[2])


def _given(p: dict, seeded: dict) -> dict:
    """Weights by name: the given ones, else the seeded ones; an unknown name is an error."""
    if unknown := sorted(set(p) - set(seeded)):
        raise ValueError(f"unknown weights: {', '.join(unknown)}")
    return {k: np.asarray(p.get(k, w), float) for k, w in seeded.items()}


@dataclass
class ConvEncoder:
    """Convolutions of several widths, each with GELU and a masked maximum, then a hidden layer, unit length.

    Weights: e, k<width> (width, hidden, hidden) and c<width> (bias) of each branch, a, a_bias, b, b_bias.
    """

    hidden: int = 48
    out: int = 64
    widths: tuple[int, ...] = (3, 5, 7)
    seed: int = 13
    p: dict = field(default_factory=dict)
    together: int = 32

    def __post_init__(self):
        rng, h = np.random.default_rng(self.seed), self.hidden
        seeded = {"e": rng.normal(0, 0.3, (VOCABULARY, h)), **{f"k{w}": _weights(rng, w, h, h) for w in self.widths}, "a": _weights(rng, h * len(self.widths), h), "b": _weights(rng, h, self.out)}
        self.p = _given(self.p, seeded | {f"c{w}": np.zeros(h) for w in self.widths} | {"a_bias": np.zeros(h), "b_bias": np.zeros(self.out)})

    def token_features(self, ids: np.ndarray) -> np.ndarray:
        return self.p["e"][ids] * (ids > 0)[..., None]

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        """States are rows of a table by byte, so a kernel's products are made once a byte and looked up.

        GELU falls, then rises: of some values its maximum is that of the least or of the largest of them.
        """
        mask, pooled, seen = (ids > 0)[..., None], [], (ids > 0).any(1)[:, None]
        rows = self.p["e"] * (np.arange(VOCABULARY) > 0)[:, None]
        for w in self.widths:
            padded, y = np.pad(ids, ((0, 0), (w // 2, w // 2))), 0
            for j in range(w):
                y = y + (rows @ self.p[f"k{w}"][j])[padded[:, j : j + ids.shape[1]]]
            y += self.p[f"c{w}"]
            most, least = np.where(mask, y, -np.inf).max(1), np.where(mask, y, np.inf).min(1)
            pooled.append(np.where(seen, np.maximum(gelu(np.where(seen, most, 0)), gelu(np.where(seen, least, 0))), 0))
        return unit(gelu(np.concatenate(pooled, 1) @ self.p["a"] + self.p["a_bias"]) @ self.p["b"] + self.p["b_bias"])


@dataclass
class AttentionEncoder:
    """Learned positions, pre-norm self-attention blocks, masked mean, unit length; padding has no influence.

    Weights: e, pos, b, scale and shift of the last norm, and for block i q<i>, k<i>, v<i>, o<i>, up<i>, down<i> and the
    scales and shifts of its two norms (scale_a<i>, shift_a<i>, scale_f<i>, shift_f<i>).
    """

    hidden: int = 64
    out: int = 64
    layers: int = 2
    heads: int = 4
    max_length: int = 256
    seed: int = 13
    p: dict = field(default_factory=dict)
    #: Scores are the square of a text's bytes: those of a few texts stay in a core's cache.
    together: int = 4

    def __post_init__(self):
        rng, h = np.random.default_rng(self.seed), self.hidden
        seeded = {"e": rng.normal(0, 0.3, (VOCABULARY, h)), "pos": rng.normal(0, 0.1, (self.max_length, h))}
        for i in range(self.layers):
            seeded |= {f"{n}{i}": _weights(rng, *s) for n, s in (("q", (h, h)), ("k", (h, h)), ("v", (h, h)), ("o", (h, h)), ("up", (h, 4 * h)), ("down", (4 * h, h)))}
            seeded |= {f"scale_{n}{i}": np.ones(h) for n in "af"} | {f"shift_{n}{i}": np.zeros(h) for n in "af"}
        self.p = _given(self.p, seeded | {"b": _weights(rng, h, self.out), "scale": np.ones(h), "shift": np.zeros(h)})

    def _norm(self, x: np.ndarray, name: str) -> np.ndarray:
        return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + 1e-5) * self.p[f"scale{name}"] + self.p[f"shift{name}"]

    def token_features(self, ids: np.ndarray) -> np.ndarray:
        """States of all positions; those of padding are 0."""
        ids = ids[:, : self.max_length]
        mask, (n, t), p = ids > 0, ids.shape, self.p
        x, split = p["e"][ids] + p["pos"][:t], lambda y: y.reshape(n, t, self.heads, -1).transpose(0, 2, 1, 3)
        for i in range(self.layers):
            y = self._norm(x, f"_a{i}")
            q, k, v = (split(y @ p[f"{c}{i}"]) for c in "qkv")
            a = (q / np.sqrt(self.hidden / self.heads)) @ k.transpose(0, 1, 3, 2)
            if not mask.all():
                a = np.where(mask[:, None, None], a, -1e9)
            a -= a.max(-1, keepdims=True)
            np.exp(a, out=a)
            x = x + ((a @ v) / a.sum(-1, keepdims=True)).transpose(0, 2, 1, 3).reshape(n, t, -1) @ p[f"o{i}"]
            x = x + gelu(self._norm(x, f"_f{i}") @ p[f"up{i}"]) @ p[f"down{i}"]
        return self._norm(x, "") * mask[..., None]

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        used = max(1, int((ids > 0).sum(1).max(initial=0)))
        ids = ids[:, :used]
        return unit(pooled_states(self.token_features(ids), ids[:, : self.max_length] > 0, "mean") @ self.p["b"])


def pooled_states(states: np.ndarray, mask: np.ndarray, mode: str = "mean") -> np.ndarray:
    """One vector a text of its token states: the masked ``mean``, or the first token's (``cls``)."""
    if mode == "cls":
        return states[:, 0]
    if mode != "mean":
        raise ValueError(f"unknown pooling: {mode}")
    m = mask[..., None]
    return (states * m).sum(1) / np.maximum(m.sum(1), 1)


@dataclass
class PooledEncoder:
    """A dense encoder of anything that gives token states: pooled, unit length."""

    tokens: object
    mode: str = "mean"

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        states = self.tokens.token_features(ids)
        return unit(pooled_states(states, ids[:, : states.shape[1]] > 0, self.mode))


@dataclass
class NumericEncoder:
    """Vectors of numeric fields: ``explicit`` values and flags, ``sinusoidal`` features, or ``xval`` (an embedding a field, scaled by its value), then two layers with GELU.

    Weights: a, a_bias, b, b_bias, and for xval one row a field in fields.
    """

    inputs: int
    out: int = 64
    mode: str = "explicit"
    depth: int = 16
    seed: int = 13
    p: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.mode not in ("explicit", "sinusoidal", "xval"):
            raise ValueError(f"unknown numeric mode: {self.mode}")
        rng, width = np.random.default_rng(self.seed), {"explicit": self.inputs * 2, "sinusoidal": self.inputs * (2 * self.depth + 1), "xval": self.out}[self.mode]
        seeded = {"a": _weights(rng, width, self.out), "a_bias": np.zeros(self.out), "b": _weights(rng, self.out, self.out), "b_bias": np.zeros(self.out)}
        self.p = _given(self.p, seeded | ({"fields": rng.normal(0, 0.02, (self.inputs, self.out))} if self.mode == "xval" else {}))

    def features(self, values: np.ndarray, present: np.ndarray) -> np.ndarray:
        if self.mode == "explicit":
            return np.concatenate([values, present], 1)
        if self.mode == "xval":
            return (values * present) @ self.p["fields"]
        phase = values[..., None] * 2.0 ** np.arange(self.depth) * np.pi
        both = [f(phase) * present[..., None] for f in (np.sin, np.cos)]
        return np.concatenate([*(x.reshape(len(values), -1) for x in both), present], 1)

    def __call__(self, values: np.ndarray, present: np.ndarray) -> np.ndarray:
        return gelu(self.features(values, present) @ self.p["a"] + self.p["a_bias"]) @ self.p["b"] + self.p["b_bias"]


@dataclass
class Student:
    """Unit-length sum of the weighted text vector and, if there is one, the numeric vector; heads read attributes and numbers from it.

    attribute_heads and numeric_heads: field to (weights, bias).
    """

    text: object
    numeric: NumericEncoder | None = None
    text_weight: float = 1.0
    attribute_heads: dict = field(default_factory=dict)
    numeric_heads: dict = field(default_factory=dict)

    def encode(self, ids: np.ndarray, values: np.ndarray | None = None, present: np.ndarray | None = None) -> np.ndarray:
        x = self.text(ids) * self.text_weight
        return unit(x if self.numeric is None or values is None else x + self.numeric(values, present))

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        return self.encode(ids)

    def logits(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {f: x @ w + b for f, (w, b) in (self.attribute_heads | self.numeric_heads).items()}


def encode_student(forms: DataFrame, student: Student, max_length: int = MAX_LENGTH) -> DataFrame:
    """forms (text, numeric as encode_numeric() makes it) with dense and, for each head, logits_<field>."""
    held, names = forms.sparkSession.sparkContext.broadcast(student), [*student.attribute_heads, *student.numeric_heads]  # a model: fixed size

    def run(batches):
        import pandas as pd

        for text, numeric in batches:
            rows = [[(x["value"], x["present"]) for x in n] if n is not None else [] for n in numeric]
            both = np.array(rows, float).reshape(len(rows), -1, 2)
            x = held.value.encode(byte_matrix(list(text), max_length), both[..., 0], both[..., 1])
            out = {"dense": list(x)} | {f"logits_{f}": list(z) for f, z in held.value.logits(x).items()}
            yield pd.DataFrame(out)

    import pandas as pd

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    udf = F.pandas_udf(run, ", ".join(f"{c} array<double>" for c in ("dense", *(f"logits_{f}" for f in names))))
    return forms.withColumn("_out", udf(F.col("text"), F.col("numeric"))).select("*", "_out.*").drop("_out")


def encode(forms: DataFrame, encoder, max_length: int = MAX_LENGTH, text_col: str = "text") -> DataFrame:
    """forms with dense: the encoder's vector of each text. Any callable from byte ids to vectors will do; equal texts are encoded once.

    Distinct texts are dealt out by number, because adaptive execution would join them into few tasks by their bytes; texts
    of like length are encoded together, so that little padding is computed.
    """
    spark = forms.sparkSession
    held = spark.sparkContext.broadcast(encoder)  # a model: fixed size
    partitions, together = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), getattr(encoder, "together", TOGETHER)

    import pandas as pd

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in texts:
            size = text.map(lambda t: len((t or "").encode())).clip(upper=max_length).to_numpy()
            order, out = np.argsort(size, kind="stable"), [None] * len(text)
            for i in range(0, len(text), together):
                part = order[i : i + together]
                for k, v in zip(part, held.value(byte_matrix(list(text.iloc[part]), max(1, int(size[part[-1]])))), strict=True):
                    out[k] = v
            yield pd.Series(out, dtype=object)

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    udf = F.pandas_udf(run, "array<double>")
    vectors = forms.select(F.col(text_col).alias("_text")).distinct().repartition(partitions).withColumn("dense", udf(F.col("_text")))
    return forms.join(vectors, F.col(text_col).eqNullSafe(F.col("_text")), "left").drop("_text")


#: Parts of a model's cache; a run reads and writes only those that its texts fall into.
BUCKETS = 256


def cached_encode(forms: DataFrame, encoder, path: str, name: str, max_length: int = MAX_LENGTH) -> DataFrame:
    """encode() through a written cache: texts that the model ``name`` has encoded before are read from path, the others are encoded and added.

    Texts fall into buckets by their hash. A bucket is written whole, its old rows with the new ones, one row a text, in place of
    what it held: a repeated or retried run leaves the same rows, and of two runs at once the later one's bucket stays. Texts may be null.
    """
    spark, schema = forms.sparkSession, "text string, dense array<double>, model string, bucket int"
    bucket = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(BUCKETS)).cast("int")
    texts = materialize(forms.select("text").distinct().withColumn("bucket", bucket), "texts")

    def held(buckets: list[int]) -> DataFrame:
        try:
            return spark.read.schema(schema).parquet(path).filter((F.col("model") == name) & F.col("bucket").isin(buckets)).select("text", "dense", "bucket")
        except AnalysisException:  # no cache yet
            return spark.createDataFrame([], "text string, dense array<double>, bucket int")

    asked = [r["bucket"] for r in texts.select("bucket").distinct().collect()]  # BUCKETS rows at most
    old = held(asked).select(F.col("text").alias("_text"), F.col("bucket").alias("_bucket"))
    same = (F.col("bucket") == F.col("_bucket")) & F.col("text").eqNullSafe(F.col("_text"))
    new = materialize(encode(texts.join(old, same, "left_anti"), encoder, max_length).select("text", "dense", "bucket"), "new-texts")
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
    if touched:
        rows = materialize(held(touched).unionByName(new).dropDuplicates(["bucket", "text"]).withColumn("model", F.lit(name)), "buckets")
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "bucket").parquet(path)
        discard(rows)
    found = held(asked).select(F.col("text").alias("_text"), "dense")
    out = forms.join(found, F.col("text").eqNullSafe(F.col("_text")), "left").drop("_text")
    discard(texts)
    discard(new)
    return out


def token_features(forms: DataFrame, encoder, max_length: int = MAX_LENGTH, text_col: str = "text", name: str = "states") -> DataFrame:
    """forms with the token states of each text, without those of padding."""
    held = forms.sparkSession.sparkContext.broadcast(encoder)  # a model: fixed size
    import pandas as pd

    def run(texts):
        for text in texts:
            ids = byte_matrix(list(text), max_length)
            states = held.value.token_features(ids)
            yield pd.Series([s[: int(n)].tolist() for s, n in zip(states, (ids > 0).sum(1), strict=True)], dtype=object)

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return forms.withColumn(name, F.pandas_udf(run, "array<array<double>>")(F.col(text_col)))


def save_student(spark, model: MeanEncoder, path: str, history: list[dict] | None = None) -> None:
    """A checkpoint: settings, weights and the metrics of each epoch, through Spark's writer."""
    rows = [("settings", json.dumps({"hidden": model.hidden, "out": model.out, "seed": model.seed}), None), ("history", json.dumps(history or []), None)]
    rows += [(k, json.dumps(w.shape), np.ascontiguousarray(w, float).tobytes()) for k, w in model.p.items()]
    spark.createDataFrame(rows, "name string, said string, data binary").coalesce(1).write.mode("overwrite").parquet(path)


def load_student(spark, path: str) -> tuple[MeanEncoder, list[dict]]:
    rows = {r["name"]: r for r in spark.read.parquet(path).collect()}  # a model: fixed size
    weights = {k: np.frombuffer(r["data"], float).reshape(json.loads(r["said"])).copy() for k, r in rows.items() if r["data"] is not None}
    return MeanEncoder(**json.loads(rows["settings"]["said"]), p=weights), json.loads(rows["history"]["said"])


class _Adam:
    """Decoupled weight decay; moments by parameter."""

    def __init__(self, p: dict, rate: float):
        self.p, self.rate, self.step = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(w) for k, w in p.items()} for _ in range(2))

    def __call__(self, grads: dict) -> None:
        self.step += 1
        for k, g in grads.items():
            self.m[k], self.v[k] = 0.9 * self.m[k] + 0.1 * g, 0.999 * self.v[k] + 0.001 * g * g
            self.p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.step) / (np.sqrt(self.v[k] / (1 - 0.999**self.step)) + 1e-8) + 1e-4 * self.p[k])


def info_nce(model: MeanEncoder, left: np.ndarray, right: np.ndarray, fact: np.ndarray, temperature: float) -> tuple[float, dict]:
    """Symmetric loss with several positives of one batch, and its gradient."""
    grads = {k: np.zeros_like(w) for k, w in model.p.items()}
    sides = [(ids, *model.parts(ids)) for ids in (left, right)]
    x, y = unit(sides[0][3]), unit(sides[1][3])
    positive = (fact[:, None] == fact[None]).astype(float)
    z = x @ y.T / temperature
    soft = lambda s, axis: np.exp(s - s.max(axis, keepdims=True)) / np.exp(s - s.max(axis, keepdims=True)).sum(axis, keepdims=True)
    rows, cols = soft(z, 1), soft(z, 0)
    loss = sum(-(np.log(np.maximum(q, 1e-300)) * positive).sum(axis) / positive.sum(axis) for q, axis in ((rows, 1), (cols, 0))).mean() / 2
    dz = (rows - positive / positive.sum(1, keepdims=True) + cols - positive / positive.sum(0, keepdims=True)) / (2 * len(fact) * temperature)
    for (ids, mean, h, raw), du, u in zip(sides, (dz @ y, dz.T @ x), (x, y), strict=True):
        draw = (du - (du * u).sum(1, keepdims=True) * u) / np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-12)
        dh = (draw @ model.p["b"].T) * (h > 0)
        grads["b"] += h.T @ draw
        grads["a"] += mean.T @ dh
        de = (dh @ model.p["a"].T) / np.maximum((ids > 0).sum(1, keepdims=True), 1)
        np.add.at(grads["e"], ids, np.broadcast_to(de[:, None], (*ids.shape, de.shape[1])))
    grads["e"][0] = 0
    return float(loss), grads


def fit_student(pairs: DataFrame, epochs: int = 3, batch: int = 128, rate: float = 3e-3, temperature: float = 0.07, seed: int = 13, share: int = 20_000, history: list[dict] | None = None) -> MeanEncoder:
    """A MeanEncoder fitted by symmetric InfoNCE on all pairs (fact_id, left_text, right_text).

    Pairs are dealt over workers of about ``share`` each. In an epoch every worker starts from the same weights and
    takes its batches in an order of that epoch; the weights are then averaged by the workers' pairs. What comes to the driver
    is the model. ``history`` gets the mean loss of each epoch.
    """
    spark, model = pairs.sparkSession, MeanEncoder(seed=seed)
    key = F.concat_ws("|", "fact_id", "left_text", "right_text")
    rows = materialize(pairs.select("fact_id", "left_text", "right_text"), "train-pairs")
    workers = max(1, -(-rows.count() // share))
    for epoch in range(epochs):
        held = spark.sparkContext.broadcast(model)  # a model: fixed size

        def run(batches, held=held):  # noqa: B008
            import pandas as pd

            own = MeanEncoder(model.hidden, model.out, model.seed, {k: w.copy() for k, w in held.value.p.items()})
            adam, n, total, rest = _Adam(own.p, rate), 0, 0.0, None

            def step(rows):
                nonlocal n, total
                fact = np.unique(rows.fact_id.astype(str), return_inverse=True)[1]
                loss, grads = info_nce(own, byte_matrix(list(rows.left_text)), byte_matrix(list(rows.right_text)), fact, temperature)
                adam(grads)
                n, total = n + len(rows), total + loss * len(rows)

            for rows in batches:
                rest = rows if rest is None else pd.concat([rest, rows])
                while len(rest) >= batch:
                    step(rest[:batch])
                    rest = rest[batch:]
            if rest is not None and len(rest):
                step(rest)
            if n:
                flat = np.concatenate([own.p[k].ravel() for k in sorted(own.p)])
                yield pd.DataFrame({"at": np.arange(len(flat) + 2), "x": np.concatenate([flat * n, [n, total]])})

        order = shuffle_key(key, seed + epoch)
        dealt = rows.withColumn("_worker", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(workers))).withColumn("_order", order)
        dealt = dealt.repartition(workers, "_worker").sortWithinPartitions("_order", "fact_id").select("fact_id", "left_text", "right_text")
        sums = {r["at"]: r["x"] for r in dealt.mapInPandas(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()}  # a row a weight
        if not sums:
            break
        flat = np.array([sums[i] for i in range(len(sums))])
        n, total, start = flat[-2], flat[-1], 0
        for k in sorted(model.p):
            model.p[k] = (flat[start : start + model.p[k].size] / n).reshape(model.p[k].shape)
            start += model.p[k].size
        if history is not None:
            history.append({"epoch": epoch + 1, "loss": total / n, "pairs": int(n)})
    return model

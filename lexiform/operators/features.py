"""Model inputs: vocabularies, numeric statistics and features, byte views, teacher distributions."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiform.functions.text import attribute, let, number, shuffle_key
from lexiform.operators.skew import looked_up, numbered, spread


def vocabularies(rows: DataFrame, fields: list[str], attrs: str = "attrs") -> DataFrame:
    """(field, value, index): distinct values of each field in order; fields without values are absent.

    All values are numbered together by ranges; a field's own numbers start at its first value.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), attribute(F.try_element_at(F.col(attrs), F.lit(f))).alias("value")) for f in fields)))
    values = rows.select(pairs.alias("p")).select("p.*").filter("value is not null").distinct()
    placed = numbered(values, ["field", "value"])
    starts = placed.groupBy("field").agg(F.min("place").alias("_start"))  # a row a field
    return placed.join(F.broadcast(starts), "field").select("field", "value", (F.col("place") - F.col("_start")).cast("int").alias("index"))


def numeric_stats(rows: DataFrame, fields: list[str], attrs: str = "attrs", strict: bool = False) -> DataFrame:
    """(field, low, high, scale = max(high - low, 1)); with strict, a field without numbers is an error."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), number(F.try_element_at(F.col(attrs), F.lit(f))).alias("v")) for f in fields)))
    stats = rows.select(pairs.alias("p")).select("p.*").filter("v is not null").groupBy("field").agg((F.min("v") + 0.0).alias("low"), (F.max("v") + 0.0).alias("high"))
    stats = stats.withColumn("scale", F.greatest(F.col("high") - F.col("low"), F.lit(1.0)))
    if strict and (missing := sorted(set(fields) - {r["field"] for r in stats.select("field").collect()})):  # a row a field
        raise ValueError(f"no numeric values: {', '.join(missing)}")
    return stats


def encode_numeric(rows: DataFrame, stats: DataFrame, fields: list[str], attrs: str = "attrs") -> DataFrame:
    """rows with numeric: for each field (value scaled by the statistics, 1 if present); absent values are (0, 0)."""
    by_field = stats.agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("low", "scale")))).alias("_stats"))  # a row a field
    out = rows.join(F.broadcast(by_field))

    def one(f: str) -> Column:
        def scaled(x: Column) -> Column:
            there = x["v"].isNotNull() & x["s"].isNotNull()
            return F.struct(F.when(there, (x["v"] - x["s"]["low"]) / x["s"]["scale"]).otherwise(0.0).alias("value"), F.when(there, 1.0).otherwise(0.0).alias("present"))

        # A value is parsed once, however often the result is used.
        return let(F.struct(number(F.try_element_at(F.col(attrs), F.lit(f))).alias("v"), F.try_element_at(F.col("_stats"), F.lit(f)).alias("s")), scaled)

    return out.withColumn("numeric", F.array(*(one(f) for f in fields))).drop("_stats")


def explicit_features(numeric: Column) -> Column:
    """All values, then all presence flags."""
    return F.concat(F.transform(numeric, lambda x: x["value"]), F.transform(numeric, lambda x: x["present"]))


def fourier_features(numeric: Column, depth: int = 16) -> Column:
    """sin, then cos, of value * 2^k * pi for each value and k, zero where absent; then the presence flags."""
    of = lambda f: F.flatten(F.transform(numeric, lambda x: F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda k: f(x["value"] * F.pow(F.lit(2.0), k) * pi) * x["present"])))
    return F.concat(of(F.sin), of(F.cos), F.transform(numeric, lambda x: x["present"]))


def hard_attributes(pools: DataFrame, attributes: DataFrame) -> DataFrame:
    """Attributes of all queries and candidates of hard pools, for statistics. attributes: fact_id, attrs."""
    facts = pools.select("benchmark_id", F.col("fact_id")).distinct().select("fact_id").unionByName(pools.select(F.col("cand_fact").alias("fact_id")))
    return facts.join(attributes.hint("merge"), "fact_id")  # as large as the pools: a packed file of it looks small enough for a broadcast


def class_forms(forms: DataFrame, per_class: int, notations: list[str] | None = None, seed: int = 13) -> DataFrame:
    """Up to per_class forms of each fact that has two of them or more, in md5 order."""
    held = forms if notations is None else forms.filter(F.col("notation").isin(*notations))
    enough = held.groupBy("fact_id").agg(F.count("*").alias("n")).filter("n >= 2").select("fact_id")
    w = Window.partitionBy("fact_id").orderBy(shuffle_key(F.col("form_id"), seed), "form_id")
    return held.join(enough, "fact_id").withColumn("take", F.row_number().over(w)).filter(F.col("take") <= per_class)


def is_digit(byte: Column) -> Column:
    return byte.between(ord("0") + 1, ord("9") + 1)


def teacher(pairs: DataFrame, exact: float = 2.0, digit: float = 1.0) -> DataFrame:
    """(pair, i, j, p): distribution over target bytes for each source byte. pairs: pair, source, target (byte ids, 0 pads).

    Equal bytes weigh ``exact``, digit pairs ``digit`` more; a source byte without any match is uniform over the target.
    For callers that want the matrix; sums over it are closed forms (teacher_rows, teacher_divergence).
    """
    rows = spread(pairs.select("pair", *_unpadded())).withColumn("p", _by_source(lambda s, law: F.transform("target", lambda t: F.when(law["total"] == 0, law["even"]).when(t == s, law["same_p"]).when(is_digit(t), law["digit_p"]).otherwise(0.0)), exact, digit))
    rows = rows.select("pair", F.posexplode("p").alias("i", "row"))
    return rows.select("pair", "i", F.posexplode("row").alias("j", "p"))


def _unpadded() -> list[Column]:
    return [F.filter(c, lambda x: x > 0).alias(c) for c in ("source", "target")]


def _by_source(use, exact: float, digit: float, source="source", target="target") -> Column:
    """use(byte, law) for each source byte. All of a row of the teacher follows from two counts in the target, of the byte itself and of digits:

    law: same and others (how many target bytes are the byte, or other digits if it is one), their chances same_p and digit_p, the weights' total
    (0: every byte has the chance ``even``), n.
    """

    def law(s: Column, digits: Column) -> Column:
        n = F.size(target)
        same = n - F.size(F.array_remove(target, s))
        others = F.when(is_digit(s), digits - same).otherwise(0)
        each = F.when(is_digit(s), exact + digit).otherwise(exact)
        total = same * each + others * digit
        return F.struct(
            same.alias("same"), others.alias("others"), total.alias("total"), n.alias("n"), (F.lit(1.0) / n).alias("even"),
            F.when(total > 0, each / total).otherwise(0.0).alias("same_p"), F.when((total > 0) & is_digit(s), digit / total).otherwise(0.0).alias("digit_p"),
        )

    return let(F.size(F.filter(target, is_digit)), lambda digits: F.transform(source, lambda s: let(law(s, digits), lambda x: use(s, x))))


def teacher_rows(pairs: DataFrame, exact: float = 2.0, digit: float = 1.0) -> DataFrame:
    """(pair, i, mass, top, entropy, targets): sum, largest chance and entropy of each row of teacher(), without its matrix."""

    def told(s: Column, law: Column) -> Column:
        plogp = lambda p: F.when(p > 0, p * F.log(p)).otherwise(0.0)
        even = law["total"] == 0
        mass = F.when(even, law["n"] * law["even"]).otherwise(law["same"] * law["same_p"] + law["others"] * law["digit_p"])
        top = F.when(even, law["even"]).when(law["same"] > 0, law["same_p"]).otherwise(law["digit_p"])
        entropy = F.when(even, F.log(law["n"].cast("double"))).otherwise(-law["same"] * plogp(law["same_p"]) - law["others"] * plogp(law["digit_p"]))
        return F.struct(mass.alias("mass"), top.alias("top"), entropy.alias("entropy"), law["n"].cast("bigint").alias("targets"))

    rows = spread(pairs.select("pair", *_unpadded())).filter(F.size("target") > 0)
    return rows.select("pair", F.posexplode(_by_source(told, exact, digit)).alias("i", "x")).select("pair", "i", "x.*")


def teacher_divergence(source, target, student, exact: float = 2.0, digit: float = 1.0) -> Column:
    """Mean over the source bytes of sum p * (log p - log q), q at least 1e-8. student: an array of q over the target for each source byte; source and target without padding.

    The first part is the teacher's entropy, which two counts give; the second needs the student's logarithms summed over the
    target bytes that are the source byte, and over digits. Null without source or target bytes.
    """
    plogp = lambda p: F.when(p > 0, p * F.log(p)).otherwise(0.0)

    def one(s: Column, law: Column) -> Column:
        own = F.when(law["total"] == 0, F.log(law["even"])).otherwise(law["same"] * plogp(law["same_p"]) + law["others"] * plogp(law["digit_p"]))
        chance = lambda t: F.when(law["total"] == 0, law["even"]).when(t == s, law["same_p"]).when(is_digit(t), law["digit_p"]).otherwise(0.0)
        return F.struct(own.alias("own"), F.transform(target, chance).alias("chance"))

    rows = _by_source(one, exact, digit, source, target)
    cross = lambda r, q: r["own"] - F.aggregate(F.zip_with(r["chance"], q, lambda p, x: F.when(p > 0, p * F.log(F.greatest(x, F.lit(1e-8)))).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    each = F.zip_with(rows, student, cross)
    return F.when((F.size(source) > 0) & (F.size(target) > 0), F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / F.size(source))


def attention(source, target, temperature: float = 1.0) -> Column:
    """A model's attention of each source position over the target's, from token states (arrays of vectors, padding left out), as an array of arrays.

    Scores are dot products over the root of the dimension times the temperature; the softmax is taken in the row.
    """
    scale = F.sqrt(F.greatest(F.size(F.get(source, F.lit(0))), F.lit(1)).cast("double")) * max(temperature, 1e-6)

    def softmax(z: Column) -> Column:
        top = F.array_max(z)
        return let(F.transform(z, lambda x: F.exp(x - top)), lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(e, lambda x: x / total)))

    dot = lambda s, t: F.aggregate(F.zip_with(s, t, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return let(scale, lambda k: F.transform(source, lambda s: let(F.transform(target, lambda t: dot(s, t) / k), softmax)))


def attention_probs(pairs: DataFrame, temperature: float = 1.0) -> DataFrame:
    """(pair, i, j, p): attention() as rows. pairs: pair, source, target."""
    rows = spread(pairs).filter((F.size("source") > 0) & (F.size("target") > 0)).select("pair", F.posexplode(attention("source", "target", temperature)).alias("i", "row"))
    return rows.select("pair", "i", F.posexplode("row").alias("j", "p"))


def anchor_pairs(forms: DataFrame) -> DataFrame:
    """(fact_id, left_id, right_id, left_text, right_text): the first form of each fact with each of its others. forms: fact_id, form_id, pos, text."""
    first = forms.groupBy("fact_id").agg(F.min(F.struct("pos", "form_id", "text")).alias("a"))
    out = forms.join(first, "fact_id").filter(F.struct("pos", "form_id") > F.struct("a.pos", "a.form_id"))
    return out.select("fact_id", F.col("a.form_id").alias("left_id"), F.col("form_id").alias("right_id"), F.col("a.text").alias("left_text"), F.col("text").alias("right_text"))


def attribute_labels(rows: DataFrame, vocabulary: DataFrame, fields: list[str], attrs: str = "attrs") -> DataFrame:
    """rows with label_<field>: the index of its attribute in the vocabulary, -1 if there is none. Vocabularies and rows of any size: labels come by joins that divide frequent values."""
    for f in fields:
        held = vocabulary.filter(F.col("field") == f)
        rows = looked_up(rows, attribute(F.try_element_at(F.col(attrs), F.lit(f))), held, "value", "index", f"label_{f}")
        rows = rows.withColumn(f"label_{f}", F.coalesce(F.col(f"label_{f}"), F.lit(-1)).cast("int"))
    return rows


def xval_features(numeric: Column, table: list[list[float]]) -> Column:
    """Sum over the fields of each field's embedding times its value; absent fields add nothing. table: one embedding a field."""
    total = F.array(*(F.lit(0.0) for _ in table[0]))

    def added(total: Column, x: Column, row: list[float]) -> Column:
        return F.zip_with(total, F.array(*(F.lit(float(w)) for w in row)), lambda a, w: a + w * x["value"] * x["present"])

    for f, row in enumerate(table):
        total = added(total, F.get(numeric, F.lit(f)), row)
    return total


def fused(text: Column, numeric: Column, text_weight: float = 1.0) -> Column:
    """Unit-length sum of the weighted text vector and the numeric vector."""
    both = F.zip_with(text, numeric, lambda a, b: a.cast("double") * text_weight + b)
    norm = lambda v: F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-12))
    return let(both, lambda v: let(norm(v), lambda n: F.transform(v, lambda x: x / n)))


def linear(v: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """A head: one value for each row of weights."""
    dot = lambda row: F.aggregate(F.zip_with(v, F.array(*(F.lit(float(w)) for w in row)), lambda a, w: a.cast("double") * w), F.lit(0.0), lambda a, x: a + x)
    return F.array(*(dot(row) + F.lit(float(b)) for row, b in zip(weights, bias, strict=True)))

"""Queries over what models read and give: attention teachers, distillation over classes, targets, numeric and fused vectors, heads."""

from __future__ import annotations

from math import sin

from pyspark.sql import functions as F

from lexiform.functions.text import byte_ids
from lexiform.operators import classes as C
from lexiform.operators import features as X
from lexiform.operators.skew import spread
from lexiform.plans.base import attrs, part_classes, query, table

DIM = 4


def _states(text):
    """Token states with given weights: dimension k of byte b is sin((b + 1) * (k + 1))."""
    ids = F.filter(byte_ids(text, 64), lambda i: i > 0)
    return F.transform(ids, lambda i: F.array(*(F.sin(i.cast("double") * (k + 1)) for k in range(DIM))))


def _attention_sql(pairs: str, name: str, source: str, target: str, temperature: float = 1.0) -> str:
    """Common table expressions: <name>(pair, i, j, s, t, p), attention over the bytes of two ASCII texts."""
    dot = " + ".join(f"sin((s + 1) * {k}.0) * sin((t + 1) * {k}.0)" for k in range(1, DIM + 1))
    return f"""
{name}_s as (select pair, i - 1 as i, ascii(substr({source}, i::int, 1)) as s, {target} as other from (select *, unnest(range(1, least(length({source}), 64) + 1)) as i from {pairs})),
{name}_t as (select pair, i, s, j - 1 as j, ascii(substr(other, j::int, 1)) as t from (select *, unnest(range(1, least(length(other), 64) + 1)) as j from {name}_s)),
{name}_z as (select *, ({dot}) / sqrt({DIM}.0) / {temperature} as z from {name}_t),
{name} as (select pair, i, j, s, t, exp(z - max(z) over w) / sum(exp(z)) over w * exp(max(z) over w) as p from {name}_z window w as (partition by pair, i))
"""


_PARTS = "pr as (select p_partkey as pair, p_brand, p_name from part)"


@query(f"with {_PARTS}, {_attention_sql('pr', 'a', 'p_brand', 'p_name', 0.5)} select pair, i::int as i, round(sum(p), 9) as mass, round(max(p), 9) as top, round(sum(p * j), 7) as centre from a group by 1, 2")
def neural_teacher(spark, d):
    """A model's attention over target bytes, at temperature 0.5."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("pair"), _states(F.col("p_brand")).alias("source"), _states(F.col("p_name")).alias("target"))
    out = X.attention_probs(p, 0.5).groupBy("pair", "i")
    return out.agg(F.round(F.sum("p"), 9).alias("mass"), F.round(F.max("p"), 9).alias("top"), F.round(F.sum(F.col("p") * F.col("j")), 7).alias("centre"))


def _kl_sql(name: str) -> str:
    """<name>_kl(pair, kl): the mean over source bytes of the divergence of <name>'s attention from the byte teacher."""
    weight = "(case when s = t then 2.0 else 0 end + case when s between 48 and 57 and t between 48 and 57 then 1.0 else 0 end)::double"
    return f"""
{name}_w as (select *, {weight} as w from {name}), {name}_r as (select *, sum(w) over (partition by pair, i) as total, count(*) over (partition by pair, i) as n from {name}_w),
{name}_q as (select pair, i, case when total > 0 then w / total else 1.0 / n end as q, p from {name}_r),
{name}_kl as (select pair, avg(kl) as kl from (select pair, i, sum(case when q > 0 then q * (ln(q) - ln(greatest(p, 1e-8))) else 0 end) as kl from {name}_q group by 1, 2) group by 1)
"""


@query(f"""
with pr as (select p_partkey::varchar || '::1' as pair, p_name as l, p_brand as r from part union all select p_partkey::varchar || '::2', p_name, p_type from part),
{_attention_sql('pr', 'lr', 'l', 'r')}, {_attention_sql('pr', 'rl', 'r', 'l')}, {_kl_sql('lr')}, {_kl_sql('rl')}
select pair, round((lr_kl.kl + rl_kl.kl) / 2, 8) as loss from lr_kl join rl_kl using (pair)
""")
def class_distillation_loss(spark, d):
    """Divergence of a model's attention from the byte teacher, both ways, between the first form of a class and each other."""
    forms = C.flatten(part_classes(spark, d)).select("fact_id", "form_id", "pos", "text")
    pairs = X.anchor_pairs(forms).select(F.col("right_id").alias("pair"), F.col("left_text").alias("l"), F.col("right_text").alias("r"))

    rows = spread(pairs).select("pair", *(f(F.col(c)).alias(f"{n}_{c}") for c in ("l", "r") for n, f in (("s", _states), ("b", lambda x: F.filter(byte_ids(x, 64), lambda i: i > 0)))))
    one = lambda s, t: X.teacher_divergence(f"b_{s}", f"b_{t}", X.attention(f"s_{s}", f"s_{t}"))
    return rows.select("pair", F.round((one("l", "r") + one("r", "l")) / 2, 8).alias("loss"))


_SIZES = "z as (select p_partkey, p_type, p_size, p_retailprice, min(p_size) over () as s0, greatest(max(p_size) over () - min(p_size) over (), 1) as s1, min(p_retailprice) over () as r0, greatest(max(p_retailprice) over () - min(p_retailprice) over (), 1) as r1 from part)"


def _targets(spark, d):
    p = table(spark, d, "part")
    rows = p.select("p_partkey", attrs(type=F.when(F.col("p_partkey") % 7 != 0, F.col("p_type")), size=F.col("p_size"), price=F.when(F.col("p_partkey") % 5 != 0, F.col("p_retailprice"))).alias("attrs"))
    every = p.select(attrs(type=F.col("p_type"), size=F.col("p_size"), price=F.col("p_retailprice")).alias("attrs"))
    out = X.attribute_labels(rows, X.vocabularies(every, ["type"]), ["type", "brand"])
    return X.encode_numeric(out, X.numeric_stats(every, ["size", "price"]), ["size", "price"])


@query(f"""
with {_SIZES}, v as (select p_type, row_number() over (order by p_type) - 1 as idx from (select distinct p_type from part))
select p_partkey, case when p_partkey % 7 = 0 then -1 else idx end::int as label_type, -1 as label_brand, round((p_size - s0) / s1::double, 9) as size, case when p_partkey % 5 = 0 then 0.0 else round((p_retailprice - r0) / r1, 9) end as price, case when p_partkey % 5 = 0 then 0.0 else 1.0 end::double as has_price
from z join v using (p_type)
""")
def pair_targets(spark, d):
    """Attribute classes and scaled numbers of training rows; missing ones are -1 and absent."""
    n = lambda i: F.get("numeric", F.lit(i))
    return _targets(spark, d).select("p_partkey", "label_type", "label_brand", F.round(n(0)["value"], 9).alias("size"), F.round(n(1)["value"], 9).alias("price"), n(1)["present"].alias("has_price"))


_TABLE = [[sin(f * 3 + k + 1) for k in range(DIM)] for f in range(2)]
_HEAD = [[sin(h * 5 + k + 2) for k in range(DIM)] for h in range(3)]
_XVAL = ", ".join(f"(p_size - s0) / s1::double * {_TABLE[0][k]!r}::double + case when p_partkey % 5 = 0 then 0.0 else (p_retailprice - r0) / r1 * {_TABLE[1][k]!r}::double end" for k in range(DIM))


@query(f"with {_SIZES}, x as (select p_partkey, [{_XVAL}] as x from z) select p_partkey, round(x[1], 9) as x0, round(x[{DIM}], 9) as x3 from x")
def numeric_xval(spark, d):
    """Field embeddings scaled by their values."""
    x = _targets(spark, d).select("p_partkey", X.xval_features(F.col("numeric"), _TABLE).alias("x"))
    return x.select("p_partkey", F.round(F.get("x", F.lit(0)), 9).alias("x0"), F.round(F.get("x", F.lit(3)), 9).alias("x3"))


@query(f"""
with {_SIZES}, x as (select p_partkey, [{_XVAL}] as x, (embedding::double[])[1:{DIM}] as e from z join embeddings on vec_id = p_partkey),
s as (select p_partkey, list_transform(range(1, {DIM + 1}), lambda k: e[k] * 2.0 + x[k]) as s from x), u as (select p_partkey, list_transform(s, lambda y: y / sqrt(list_dot_product(s, s))) as u from s)
select p_partkey, round(u[1], 9) as u0, {", ".join(f"round({' + '.join(f'u[{k + 1}] * {w!r}::double' for k, w in enumerate(row))} + {h}, 9) as head{h}" for h, row in enumerate(_HEAD))} from u
""")
def student_heads(spark, d):
    """Text vectors at weight 2 and numeric vectors in one, and a head of three classes over them."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("p_partkey"), F.slice("embedding", 1, DIM).alias("e"))
    x = _targets(spark, d).join(e, "p_partkey").select("p_partkey", X.fused(F.col("e"), X.xval_features(F.col("numeric"), _TABLE), 2.0).alias("u"))
    x = x.select("p_partkey", "u", X.linear(F.col("u"), _HEAD, [0.0, 1.0, 2.0]).alias("z"))
    return x.select("p_partkey", F.round(F.get("u", F.lit(0)), 9).alias("u0"), *(F.round(F.get("z", F.lit(h)), 9).alias(f"head{h}") for h in range(3)))

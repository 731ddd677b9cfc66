"""Forward losses as relations: logits are rows (batch, i, j, z, positive)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiform.operators.metrics import dot, per_query


#: Scores that one task makes and sorts, about: batches are dealt out by their number, because adaptive execution would join them by the bytes of their vectors.
SCORES = 1 << 19


def logits(left: DataFrame, right: DataFrame, temperature: float = 0.07, batch: int = 128) -> DataFrame:
    """Scaled dot products of all (left, right) of a batch. Both: row, fact_id, v of unit length."""
    conf = left.sparkSession.conf
    parts = max(int(conf.get("spark.sql.shuffle.partitions")), -(-left.count() * batch // SCORES))
    l = left.select(F.floor(F.col("row") / batch).alias("batch"), F.col("row").alias("i"), F.col("fact_id").alias("lf"), F.col("v").alias("x"))
    r = right.select(F.floor(F.col("row") / batch).alias("batch"), F.col("row").alias("j"), F.col("fact_id").alias("rf"), F.col("v").alias("y"))
    l, r = (side.repartition(parts, "batch") for side in (l, r))
    return l.join(r.hint("merge"), "batch").select("batch", "i", "j", (dot(F.col("x"), F.col("y")) / temperature).alias("z"), (F.col("lf") == F.col("rf")).alias("positive"))


def _log_softmax(by: list[str]) -> Column:
    w = Window.partitionBy(*by)
    top = F.max("z").over(w)
    return F.col("z") - top - F.log(F.sum(F.exp(F.col("z") - top)).over(w))


def _direction(rows: DataFrame, side: str) -> DataFrame:
    each = rows.withColumn("lp", _log_softmax(["batch", side])).groupBy("batch", side).agg(F.sum(F.when(F.col("positive"), F.col("lp")).otherwise(0.0)).alias("s"), F.count_if("positive").alias("n"))
    return each.groupBy("batch").agg(F.avg(-F.col("s") / F.greatest("n", F.lit(1))).alias(f"loss_{side}"))


def contrastive(rows: DataFrame) -> DataFrame:
    """(batch, loss): symmetric InfoNCE with several positives."""
    return _direction(rows, "i").join(_direction(rows, "j"), "batch").select("batch", ((F.col("loss_i") + F.col("loss_j")) / 2).alias("loss"))


def supervised_contrastive(rows: DataFrame) -> DataFrame:
    """(batch, loss) within one set of forms: a form is not its own positive; forms without positives are skipped; 0 if all are."""
    apart = rows.filter("i <> j")
    each = apart.withColumn("lp", _log_softmax(["batch", "i"])).groupBy("batch", "i").agg(F.sum(F.when(F.col("positive"), F.col("lp"))).alias("s"), F.count_if("positive").alias("n"))
    return each.groupBy("batch").agg(F.coalesce(F.avg(F.when(F.col("n") > 0, -F.col("s") / F.col("n"))), F.lit(0.0)).alias("loss"))


def attention_kl(teacher: DataFrame, student: DataFrame) -> DataFrame:
    """(pair, loss): mean over source bytes of sum p * (log p - log q). Both: pair, i, j and p or q."""
    both = teacher.filter("p > 0").join(student, ["pair", "i", "j"])
    row = both.groupBy("pair", "i").agg(F.sum(F.col("p") * (F.log("p") - F.log(F.greatest("q", F.lit(1e-8))))).alias("kl"))
    return row.groupBy("pair").agg(F.avg("kl").alias("loss"))


def attribute_loss(rows: DataFrame) -> DataFrame:
    """(loss, accuracy) of class logits (row, label, scores array); label -1 is ignored."""
    held = rows.filter("label >= 0")
    top = F.array_max("scores")
    lse = top + F.log(F.aggregate(F.transform("scores", lambda s: F.exp(s - top)), F.lit(0.0), lambda a, x: a + x))
    return held.agg(
        F.coalesce(F.avg(lse - F.get("scores", F.col("label"))), F.lit(0.0)).alias("loss"),
        F.coalesce(F.avg(F.when(F.array_position("scores", top) - 1 == F.col("label"), 1.0).otherwise(0.0)), F.lit(0.0)).alias("accuracy"),
    )


def numeric_consistency(rows: DataFrame) -> DataFrame:
    """(loss, mae) of predictions l and r of a true value: squared errors of both sides and of their agreement, where present."""
    held = rows.filter("present = 1")
    sq = lambda a, b: F.pow(F.col(a) - F.col(b), F.lit(2.0))
    loss = (F.avg(sq("l", "value")) + F.avg(sq("r", "value")) + F.avg(sq("l", "r"))) / 3
    mae = (F.avg(F.abs(F.col("l") - F.col("value"))) + F.avg(F.abs(F.col("r") - F.col("value")))) / 2
    return held.agg(F.coalesce(loss, F.lit(0.0)).alias("loss"), F.coalesce(mae, F.lit(0.0)).alias("mae"))


def hard_pool_loss(rows: DataFrame) -> DataFrame:
    """(benchmark_id, loss) = log-sum-exp of all scores z less that of the positives' scores."""
    w = Window.partitionBy("benchmark_id")
    rows = rows.withColumn("e", F.exp(F.col("z") - F.max("z").over(w)))
    return rows.groupBy("benchmark_id").agg((F.log(F.sum("e")) - F.log(F.sum(F.when(F.col("positive"), F.col("e"))))).alias("loss"))


def hard_pool_evaluation(rows: DataFrame) -> DataFrame:
    """One row, an evaluation step over hard pools: mean loss, mean place of the first positive, top1, top5, mean_reciprocal_rank, pools.

    rows: benchmark_id, cand_idx, z, positive. Ties stand in order of cand_idx; a pool without a positive has no place and no loss.
    """
    place = F.row_number().over(Window.partitionBy("benchmark_id").orderBy(F.desc("z"), "cand_idx"))
    ranks = rows.withColumn("place", place).groupBy("benchmark_id").agg(F.min(F.when(F.col("positive"), F.col("place"))).cast("bigint").alias("rank"))
    both = per_query(ranks.join(hard_pool_loss(rows), "benchmark_id"))
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return both.agg(mean("loss").alias("loss"), F.avg("rank").alias("mean_rank"), mean("top1").alias("top1"), mean("top5").alias("top5"), mean("rr").alias("mean_reciprocal_rank"), F.count("*").alias("pools"))


def history(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Means of batch values by key (an epoch)."""
    return rows.groupBy(*keys).agg(*(F.avg(v).alias(v) for v in values))

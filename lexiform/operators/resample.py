"""Resampling of exactly n rows by binomial splitting.

A resample of n rows with replacement is a multinomial draw over the distinct values. Down a binary tree over
the values in order, each node hands its draws on: the left half gets a binomial part of them, by the rows that
it holds. So a resample always has n rows, and the work follows the number of distinct values. The draw of a node
comes from md5(resample|level|first|end|seed), so samples repeat in SQL.

The tree is cut into levels of FAN children. A task holds the children of one node and a block of resamples,
whatever the number of values; levels follow each other as joins.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiform.operators.skew import numbered
from lexiform.sources.shared import materialize

FAN, RESAMPLES = 256, 125


def quantiles(m: np.ndarray, left: int, right: int, chance: np.ndarray) -> np.ndarray:
    """For each m the binomial number of m draws, of which left / (left + right) fall to the left, at the given chance.

    Chances below a number are summed over 12 deviations around the mean; equal m share their sums.
    """
    sizes, which = np.unique(m, return_inverse=True)
    out, p = np.zeros(len(m), np.int64), left / (left + right)
    order = np.argsort(which, kind="stable")
    edges = np.searchsorted(which[order], np.arange(len(sizes) + 1))
    for i, size in enumerate(sizes.tolist()):
        reach = 12 * np.sqrt(size * p * (1 - p)) + 20
        low, high = max(0, int(np.floor(size * p - reach))), min(size, int(np.ceil(size * p + reach)))
        k = np.arange(low + 1, high + 1, dtype=float)
        log = np.concatenate([[0.0], np.cumsum(np.log((size - k + 1) / k * left / right))])
        weight = np.exp(log - log.max())
        below = np.cumsum(weight)
        own = order[edges[i] : edges[i + 1]]
        out[own] = low + np.minimum(np.searchsorted(below / below[-1], chance[own], "left"), high - low)
    return out


def chances(resamples: np.ndarray, level: int, first: int, end: int, seed: int) -> np.ndarray:
    return np.array([int(hashlib.md5(f"{b}|{level}|{first}|{end}|{seed}".encode()).hexdigest()[:13], 16) for b in resamples.tolist()]) / float(1 << 52)


def split(rows: np.ndarray, m: np.ndarray, resamples: np.ndarray, level: int, start: int, seed: int) -> np.ndarray:
    """[resample, child] draws: m draws of each resample handed down to children that hold so many rows. start: number of the first child."""
    out = np.zeros((len(m), len(rows)), np.int64)
    total = np.concatenate([[0], np.cumsum(rows)])
    todo = [(0, len(rows), m)]
    while todo:
        lo, hi, held = todo.pop()
        if hi - lo == 1:
            out[:, lo] = held
            continue
        mid = (lo + hi) // 2
        part = quantiles(held, int(total[mid] - total[lo]), int(total[hi] - total[mid]), chances(resamples, level, start + lo, start + hi, seed))
        todo += [(lo, mid, part), (mid, hi, held - part)]
    return out


def _handed_down(level: int, sums: list[str], seed: int):
    """For a node's children and a block of resamples with the node's draws: the children's draws, or on the last level the sums."""

    def run(children, held):
        import pandas as pd

        if not len(children) or not len(held):
            return pd.DataFrame({c: [] for c in (["b", "n", *sums] if level == 0 else ["node", "b", "m"])})
        children, b = children.sort_values("child"), held["b"].to_numpy()
        found = split(children["rows"].to_numpy(), held["m"].to_numpy(), b, level, int(children["child"].iloc[0]), seed)
        if level == 0:
            return pd.DataFrame({"b": b, "n": found.sum(1)} | {c: found @ children[c].to_numpy() for c in sums})
        at, child = np.nonzero(found)
        return pd.DataFrame({"node": children["child"].to_numpy()[child], "b": b[at], "m": found[at, child]})

    return run


def resampled_sums(rows: DataFrame, value: str, sums: list[str], resamples: int, seed: int) -> DataFrame:
    """(b, n, <sums>): for each resample its size and the sums of the columns ``sums``, which ``value`` decides. As many rows as rows has are drawn."""
    seen = rows.groupBy(value, *sums).agg(F.count("*").alias("rows"))
    leaves = materialize(numbered(seen, [value], "child"), "values")
    levels = [leaves]
    while levels[-1].count() > FAN:
        up = levels[-1].select(F.floor(F.col("child") / FAN).alias("child"), "rows").groupBy("child").agg(F.sum("rows").alias("rows"))
        levels.append(materialize(up, "nodes"))
    blocks = max(1, -(-resamples // RESAMPLES))
    total = levels[-1].agg(F.sum("rows").alias("m")).filter("m is not null")
    draws = total.select(F.lit(0).cast("long").alias("node"), F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b"), "m")
    for level in range(len(levels) - 1, -1, -1):
        node = F.floor(F.col("child") / FAN) if level < len(levels) - 1 else F.lit(0).cast("long")
        children = levels[level].select(node.alias("node"), "child", "rows", *(sums if level == 0 else [])).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        own = draws.withColumn("block", F.pmod("b", F.lit(blocks)).cast("int"))
        schema = ", ".join(["b int", "n long", *(f"{c} double" for c in sums)]) if level == 0 else "node long, b int, m long"
        draws = children.groupBy("node", "block").cogroup(own.groupBy("node", "block")).applyInPandas(_handed_down(level, sums, seed), schema)
    return draws.groupBy("b").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in sums))

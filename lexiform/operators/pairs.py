"""Positive pairs and hard candidate pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiform.functions.text import position_of, shuffle_key
from lexiform.operators.classes import first_rows, of_notation
from lexiform.operators.splits import placed_in
from lexiform.sources.shared import materialize


def pairs_of_classes(classes: DataFrame, left: str, right: str, limit: int | None = None) -> DataFrame:
    """All (left, right) forms of one fact with different texts. Both sides come from the class's own row: no shuffle."""
    rest = [c for c in ("track", "attrs", "attr_lists") if c in classes.columns]
    rows = classes.select("fact_id", *rest, F.posexplode(of_notation("forms", left)).alias("left_pos", "l"), of_notation("forms", right).alias("_rights"))
    rows = rows.select("*", F.posexplode("_rights").alias("right_pos", "r")).drop("_rights").filter("l.text <> r.text")
    out = rows.select("fact_id", *rest, "left_pos", "right_pos", F.col("l.text").alias("left_text"), F.col("l.notation").alias("left_notation"), F.col("r.text").alias("right_text"), F.col("r.notation").alias("right_notation"))
    return out if limit is None else out.orderBy("fact_id", "left_pos", "right_pos").limit(limit)


def pairs_of_forms(forms: DataFrame, left: str, right: str, left_split: str | None = None, right_split: str | None = None, limit: int | None = None) -> DataFrame:
    """The same from flat rows, each side of its own split; attributes are those of the fact's first row."""
    side = lambda n, s: (forms.filter(F.col("notation") == n) if s is None else forms.filter((F.col("notation") == n) & (F.col("split") == s)))
    first = first_rows(forms.select("fact_id", "form_id", "pos", "track", *(["attrs"] if "attrs" in forms.columns else [])), ["fact_id"], [F.col("pos"), F.col("form_id")]).drop("form_id", "pos")
    l = side(left, left_split).select("fact_id", F.col("pos").alias("left_pos"), F.col("text").alias("left_text"), F.col("notation").alias("left_notation"))
    r = side(right, right_split).select("fact_id", F.col("pos").alias("right_pos"), F.col("text").alias("right_text"), F.col("notation").alias("right_notation"))
    out = l.join(r, "fact_id").filter("left_text <> right_text").join(first, "fact_id")
    return out if limit is None else out.orderBy("fact_id", "left_pos", "right_pos").limit(limit)


def matches_key(text: Column, fields: dict[str, Column]) -> Column:
    """False only if the text states another value for a field than the expected one."""
    ok = F.lit(True)
    for name, expected in fields.items():
        ok = ok & F.coalesce(position_of(text, name) == expected.try_cast("bigint"), F.lit(True))
    return ok


def hard_pools(
    classes: DataFrame, query_notation: str, candidate_notation: str, fields: list[str], max_candidates: int = 20, min_decoys: int = 1, positives: int = 1,
    fill_random: bool = False, seed: int = 13, max_queries: int | None = None,
) -> DataFrame:
    """(benchmark_id, fact_id, query_text, cand_idx, candidate fact, text and decoy_kind): pools of candidates that share the query's attributes.

    Facts of equal values of all ``fields`` stand in a seeded circle, and each takes those that follow it, one
    form each, up to the room that the positives leave. ``fill_random`` adds, where a circle is too small,
    facts of other keys: those that follow a seeded place in the circle of all facts. So each fact
    meets max_candidates others by equal joins, whatever the size of its key. Both sides of these joins grow with the facts: they
    are merged, as packed files look small enough for a broadcast long after their rows are not. Facts with a missing
    field, without positives or with too few decoys have no pool.
    """
    if max_candidates < positives + min_decoys:
        raise ValueError("max_candidates leaves no room for the decoys")
    room = max_candidates - positives
    values = [F.try_element_at(F.col("attrs"), F.lit(f)) for f in fields]
    key = F.struct(*(v.alias(f) for v, f in zip(values, fields, strict=True)))
    usable = classes.filter(" and ".join(f"coalesce(try_element_at(attrs, '{f}'), '') <> ''" for f in fields))
    usable = usable.select("fact_id", key.alias("key"), of_notation("forms", query_notation).alias("queries"), of_notation("forms", candidate_notation).alias("cands")).filter(F.size("cands") > 0)
    one = F.element_at(F.array_sort(F.transform("cands", lambda c: F.struct(shuffle_key(F.concat(F.col("fact_id"), F.lit("|"), c["text"]), seed).alias("k"), c["text"].alias("text")))), 1)["text"]
    fits = F.filter("queries", lambda q: matches_key(q["text"], {f: F.col(f"key.{f}") for f in fields}))
    facts = usable.select("fact_id", "key", one.alias("d_text"), F.transform(fits, lambda q: q["text"]).alias("queries"), F.transform("cands", lambda c: c["text"]).alias("pos"))
    facts = placed_in(facts, ["key"], "fact_id", seed, "at", "of")
    if fill_random:
        facts = placed_in(facts, [], "fact_id", seed, "at_all", "of_all")
    facts = materialize(facts, "pool-facts")
    asked = facts.filter((F.size("queries") > 0) & (F.col("of") > F.greatest(F.lit(min_decoys), F.lit(1))))
    decoys = facts.select("key", F.col("at").alias("d_at"), F.col("fact_id").alias("d_fact"), "d_text")
    step = F.explode(F.sequence(F.lit(1), F.least(F.lit(room), F.col("of") - 1))).alias("step")
    drawn = asked.select("fact_id", "key", "at", "of", step).withColumn("d_at", (F.col("at") + F.col("step")) % F.col("of")).join(decoys.hint("merge"), ["key", "d_at"])
    drawn = drawn.select("fact_id", F.col("step").alias("n"), "d_fact", "d_text", F.lit("matched").alias("kind"))
    if fill_random:
        start = F.conv(F.substring(F.md5(F.concat("fact_id", F.lit(f"|random|{seed}"))), 1, 15), 16, 10).cast("bigint")
        # Among room + 1 facts in a row are at most the key's own that do not count, so enough are left.
        step = F.explode(F.sequence(F.lit(0), F.least(F.lit(room), F.col("of_all") - 1))).alias("step")
        spare = asked.filter(F.col("of") - 1 < room).select("fact_id", "key", "of_all", start.alias("start"), step).withColumn("at_all", (F.col("start") + F.col("step")) % F.col("of_all"))
        others = facts.select("at_all", F.col("key").alias("d_key"), F.col("fact_id").alias("d_fact"), "d_text")
        spare = spare.join(others.hint("merge"), "at_all").filter(~F.col("key").eqNullSafe(F.col("d_key")))
        drawn = drawn.unionByName(spare.select("fact_id", (F.col("step") + room + 1).alias("n"), "d_fact", "d_text", F.lit("random").alias("kind")))
    held = F.slice(F.array_sort(F.collect_list(F.struct("n", "d_fact", "d_text", "kind"))), 1, room)
    pool = asked.select("fact_id", "queries", "pos").join(drawn.groupBy("fact_id").agg(held.alias("decoys")).hint("merge"), "fact_id")
    goods = F.transform(F.slice("pos", 1, positives), lambda t: F.struct(F.lit(0).cast("bigint").alias("n"), F.col("fact_id").alias("d_fact"), t.alias("d_text"), F.lit("positive").alias("kind"))).cast("array<struct<n:bigint,d_fact:string,d_text:string,kind:string>>")
    pool = pool.select("fact_id", F.posexplode("queries").alias("q", "query_text"), F.concat("decoys", goods).alias("pool"))
    pool = pool.withColumn("benchmark_id", F.concat("fact_id", F.lit("::"), F.lit(query_notation), F.lit("::"), F.col("q").cast("string")))
    if max_queries is not None:
        pool = pool.orderBy("benchmark_id").limit(max_queries)
    order = lambda c: F.md5(F.concat(F.col("benchmark_id"), F.lit("|"), c["d_fact"], F.lit("|"), c["d_text"]))
    ranked = F.array_sort(F.transform("pool", lambda c: F.struct(order(c).alias("k"), c["d_fact"].alias("d_fact"), c["n"].alias("n"), c["d_text"].alias("d_text"), c["kind"].alias("kind"))).cast("array<struct<k:string,d_fact:string,n:bigint,d_text:string,kind:string>>"))
    out = pool.select("benchmark_id", "fact_id", "query_text", F.posexplode(ranked).alias("cand_idx", "c"))
    return out.select("benchmark_id", "fact_id", "query_text", "cand_idx", F.col("c.d_fact").alias("cand_fact"), F.col("c.d_text").alias("cand_text"), F.col("c.kind").alias("decoy_kind"))


def matched_only(pools: DataFrame) -> DataFrame:
    """Pools without random decoys, indexed anew."""
    w = Window.partitionBy("benchmark_id").orderBy("cand_idx")
    return pools.filter("decoy_kind <> 'random'").withColumn("cand_idx", F.row_number().over(w) - 1)


def composition(pools: DataFrame) -> DataFrame:
    """One row: number of pools, candidates a pool, decoys by kind, pools without random decoys."""
    size = pools.groupBy("benchmark_id").agg(F.count("*").alias("n"), F.count_if(F.col("decoy_kind") == "matched").alias("matched"), F.count_if(F.col("decoy_kind") == "random").alias("random"))
    return size.agg(
        F.count("*").alias("pools"), F.round(F.avg("n"), 9).alias("avg_candidates"), F.min("n").alias("min_candidates"), F.max("n").alias("max_candidates"),
        F.coalesce(F.sum("matched"), F.lit(0)).alias("matched"), F.coalesce(F.sum("random"), F.lit(0)).alias("random"), F.count_if(F.col("random") == 0).alias("all_hard"),
    )

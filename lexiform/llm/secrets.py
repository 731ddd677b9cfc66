"""Secret scans with corpus-wide ownership frequency, with DataFrame functions only.

Base kinds are found by fixed patterns. A further kind, ``owned``, covers mixed
tokens of OWNED_CHARS or more that no base span covers. The hashes of all candidates, base
values too, are counted over the corpus by distinct owners and repositories. A value is
live-looking if it occurs with at most ``max_owners`` owners and in at most
``max_repos`` repositories: such tokens become spans; widely copied ones are examples and
do not. Base spans always stay; ``n_live`` counts those whose value is live-looking.
``ownership`` lists each candidate's counts and verdict.

Positions come from the pattern's matches and the pieces between them, so no
Python runs. A token may occur in a third of all rows: counts are pre-aggregated
by (hash, owner, repository), and the counts of such tokens are broadcast to their
occurrences; they are fewer than a constant.

Defined cases: null text is empty; a null owner or repository counts as one of its
own; rows may repeat ids and texts (equal rows get equal results); texts are
scanned whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiform.llm.common import join_stats, let, materialize, prefix_sums

#: Fixed patterns: kind, pattern, group of the value, least length of the value.
BASE = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
]
OWNED_CHARS, MAX_OWNERS, MAX_REPOS = 20, 2, 4
OWNED = ("owned", rf"[A-Za-z0-9_-]{{{OWNED_CHARS},}}", 0, OWNED_CHARS)


def matches(text: Column, pattern: str, group: int) -> Column:
    """array<struct<start, end, value>> of all matches; start and end of the whole match in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    # The text before each match since the last one, and the match: lengths are taken once, starts are sums of what stands before.
    before = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    parts = F.transform(F.arrays_zip(before.alias("b"), found.alias("m"), values.alias("v")), lambda x: F.struct(F.length(x["b"]).alias("gap"), F.length(x["m"]).alias("length"), x["v"].alias("value")))

    def spans(p: Column) -> Column:
        starts = prefix_sums(F.transform(p, lambda x: (x["gap"] + x["length"]).cast("bigint")))
        return F.zip_with(p, starts, lambda x, at: F.struct((at + x["gap"]).cast("int").alias("start"), (at + x["gap"] + x["length"]).cast("int").alias("end"), x["value"].alias("value")))

    return let(parts, spans)


SPANS = "array<struct<start:int,ord:int,end:int,kind:string,value:string>>"
TOLD = "array<struct<start:int,ord:int,end:int,kind:string,owners:bigint,repos:bigint,occurrences:bigint,live:boolean>>"


def _kind(text: Column, order: int, kind: str, pattern: str, group: int, least: int) -> Column:
    kept = F.filter(matches(text, pattern, group), lambda m: F.length(m["value"]) >= least)
    spans = F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("ord"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["value"].alias("value")))
    return F.when(text.rlike(pattern), spans.cast(SPANS)).otherwise(F.array().cast(SPANS))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_cols: list[str]) -> DataFrame:
    """A row for each row of docs, without its text, numbered by rid: base spans in order, and mixed tokens, which base spans may cover."""
    text = F.coalesce(F.col("text"), F.lit(""))
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), known(owner_col).alias("owner"), F.concat_ws("\1", *map(known, repo_cols)).alias("repo"))
    rows = rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "owner", "repo", *(_kind(text, i, *k).alias(k[0]) for i, k in enumerate(BASE)), _kind(text, len(BASE), *OWNED).alias("other"))
    base = F.array_sort(F.concat(*(F.col(k[0]) for k in BASE)))
    mixed = lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]")
    return rows.withColumn("base", base).withColumn("other", F.filter("other", mixed))


def candidates(rows: DataFrame) -> DataFrame:
    """(rid, owner, repo, start, ord, end, kind, hash): all base spans and the tokens that no base span covers.

    In the order of places, base spans at their starts and tokens at their ends, a token is covered if an earlier base span ends behind
    its start: a running maximum, linear but for the sort in the number of spans of a text.
    """
    spans = rows.select("rid", "owner", "repo", F.explode(F.concat("base", "other")).alias("s"))
    spans = spans.select("rid", "owner", "repo", "s.start", "s.ord", "s.end", "s.kind", F.unhex(F.sha2(F.col("s.value").cast("binary"), 256)).alias("hash"))
    own = F.col("ord") < len(BASE)
    w = Window.partitionBy("rid").orderBy(F.when(own, F.col("start")).otherwise(F.col("end")), own).rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(own, F.col("end"))).over(w)
    return spans.withColumn("reach", reach).filter(own | F.col("reach").isNull() | (F.col("reach") <= F.col("start"))).drop("reach")


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, owners, repos, occurrences) of candidates (hash, owner, repo): partial sums before every shuffle."""
    by_repo = candidates.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.sum("n").alias("occurrences"))


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS
) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_live (base spans with a live-looking value), ownership (counts of all candidates in order)."""
    rows = materialize(scan(docs, id_col, text_col, owner_col, list(repo_cols)), "spans")
    some = rows.filter((F.size("base") > 0) | (F.size("other") > 0))
    held = materialize(candidates(some), "candidates")
    stats = materialize(ownership(held), "ownership")
    live = ((F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)).alias("live")
    counted = join_stats(held.select("rid", "start", "ord", "end", "kind", "hash"), stats, "hash", "occurrences")
    told = F.array_sort(F.collect_list(F.struct("start", "ord", "end", "kind", "owners", "repos", "occurrences", live)))
    both = some.join(counted.groupBy("rid").agg(told.alias("told")), "rid", "left").withColumn("told", F.coalesce("told", F.array().cast(TOLD)))
    both = both.withColumn("shown", F.filter("told", lambda s: (s["ord"] < len(BASE)) | s["live"])).withColumn("n_live", F.size(F.filter("told", lambda s: (s["ord"] < len(BASE)) & s["live"])).cast("long"))
    both = both.withColumn("ownership", F.transform("told", lambda s: F.struct(*(s[c].alias(c) for c in ("kind", "start", "end", "owners", "repos", "occurrences", "live")))))
    kind = both.schema["ownership"].dataType
    none = rows.filter((F.size("base") == 0) & (F.size("other") == 0))
    none = none.withColumn("shown", F.array().cast(TOLD)).withColumn("n_live", F.lit(0).cast("long")).withColumn("ownership", F.array().cast(kind))
    return both.drop("told").unionByName(none).select(
        "doc_id",
        *(F.size(k[0]).cast("long").alias(f"n_{k[0]}") for k in BASE),
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("shown")).alias("spans"),
        F.size(F.filter("shown", lambda s: s["ord"] == len(BASE))).cast("long").alias("n_owned"),
        "n_live",
        "ownership",
    )

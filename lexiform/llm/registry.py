"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiform.llm.common import table


def op1_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiform.llm.quality_fm import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiform.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


def op3_bpe_prefix_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lexiform.llm.prefix_bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiform.llm.ngram_join import near_copies

    return near_copies(table(spark, sf_dir, "documents"))


def op5_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiform.llm.secrets import find_secrets

    return find_secrets(table(spark, sf_dir, "documents"))


def op6_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiform.llm.decontaminate import find_overlaps

    return find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiform.llm.toxicity import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_chat_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations come as records of six layouts; the fingerprint finds each one's mapping."""
    from lexiform.llm.chat_format import conversation_records, dealt_layouts, digests, format_chats

    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return digests(format_chats(dealt_layouts(conversation_records(rows.unionByName(probe)))))


def op9_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiform.llm.pii_feistel import pseudonymise

    return pseudonymise(table(spark, sf_dir, "documents"), key=b"a key that a caller would keep secret")


def op10_bloom_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiform.llm.exact_dedup import duplicate_groups

    return duplicate_groups(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiform.llm.filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lexiform.llm.token_alignment import align_documents

    return align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by 20."""
    from lexiform.llm.additive_ann import neighbours

    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


PROBE = r"\### Assistant: </turn> ok"
OP8_SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
esc as (
  select *, replace(replace(replace(replace(text, '\', '\b'), '<turn>', '\cturn>'), '</turn>', '\c/turn>'), '### ', '\h## ') as body from rows)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(6 + length(role) + 1 + length(body) + 8)::bigint as formatted_chars
from esc group by conv_id
"""
OP10_SQL = """
with d as (select doc_id, coalesce(text, '') as t from documents),
g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, sha256(d.t) as text_sha256
from d join g on d.t = g.t
"""
OP11_SQL = r"""
with w as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
f as (select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws, min(doc_id) over (partition by t) as least from w),
b as (
  select part, (len(ws) < 200)::int + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::int + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::int
    + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > least, false)::int as m,
    doc_id in (select doc_id from labels where quality = 1 and doc_id is not null) as good, doc_id in (select doc_id from labels where toxic = 1 and doc_id is not null) as toxic from f),
c as (select part, m, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic from b group by 1, 2),
l(l, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o as (select v.l || w.l || x.l || y.l || z.l as filter_order, [v.bit, w.bit, x.bit, y.bit, z.bit] as bits from l v, l w, l x, l y, l z where v.bit | w.bit | x.bit | y.bit | z.bit = 31),
s as (select filter_order, step, bits[step] as bit, coalesce(list_sum(bits[1:step - 1]), 0)::int as before from o, range(1, 6) r(step)),
r as (
  select part, filter_order, step, bit, sum(n) filter (where m & (before | bit) = 0) as kept, sum(n) filter (where m & bit <> 0 and m & before = 0) as removed, sum(n) filter (where m & bit <> 0 and m & before <> 0) as redundant,
    sum(n) filter (where m = bit) as unique_fails, sum(good) filter (where m & bit <> 0 and m & before = 0) as good_lost, sum(toxic) filter (where m & bit <> 0 and m & before = 0) as toxic_lost
  from c, s group by 1, 2, 3, 4)
select part, filter_order, step::int as step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails,
  coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost, coalesce(sum(removed) over (partition by part, bit), 0)::bigint as shapley from r
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_quality_fm,
        op2_label_propagation_shards,
        op3_bpe_prefix_dp,
        op4_ngram_jaccard_join,
        op5_secret_ownership,
        op6_spaced_seed_decontamination,
        op7_toxicity_mil,
        op8_chat_fingerprints,
        op9_feistel_pseudonyms,
        op10_bloom_exact_dedup,
        op11_filter_audit,
        op12_token_alignment,
        op13_additive_ann,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op8_chat_fingerprints": OP8_SQL, "op10_bloom_exact_dedup": OP10_SQL, "op11_filter_audit": OP11_SQL}

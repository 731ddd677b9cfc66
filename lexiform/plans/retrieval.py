"""Queries over pairs, pools, rankings, metrics, features of models and forward losses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiform.operators import classes as C
from lexiform.operators import encoders as E
from lexiform.operators import features as X
from lexiform.operators import grams as G
from lexiform.operators import losses as L
from lexiform.operators import metrics as M
from lexiform.operators import pairs as P
from lexiform.operators import ranking as R
from lexiform.operators import splits as S
from lexiform.operators.bounded import first_match
from lexiform.operators.skew import spread
from lexiform.plans.base import CONV_SQL, PART_SQL, conversation_classes, part_classes, query, table
from lexiform.sources import files
from lexiform.sources.shared import materialize, new_path


@query(f"""
with {CONV_SQL} select l.fact_id, l.form_id as left_id, r.form_id as right_id, md5(l.text) as left_md5, md5(r.text) as right_md5
from forms l join forms r using (fact_id) where l.notation = 'user' and r.notation = 'assistant' and l.text <> r.text
""")
def positive_pairs(spark, d):
    rows = C.flatten(conversation_classes(spark, d)).select("fact_id", "form_id", "pos", "track", "attrs", "notation", "text")
    out = P.pairs_of_forms(rows, "user", "assistant")
    at = lambda c: F.concat(F.col("fact_id"), F.lit("::"), F.col(c).cast("string"))
    return out.select("fact_id", at("left_pos").alias("left_id"), at("right_pos").alias("right_id"), F.md5("left_text").alias("left_md5"), F.md5("right_text").alias("right_md5"))


@query("select p_partkey::varchar as fact_id, p_name as left_text, p_brand as right_text from part where p_name <> p_brand")
def class_pairs(spark, d):
    return P.pairs_of_classes(part_classes(spark, d), "name", "brand").select("fact_id", "left_text", "right_text")


_POOLS = """
k as (select p_partkey::varchar as fact_id, p_type, p_size, p_name, p_brand, md5(p_partkey::varchar || '|13') as h from part),
p as (select *, row_number() over (partition by p_type, p_size order by h, fact_id) - 1 as at, count(*) over (partition by p_type, p_size) as m, row_number() over (order by h, fact_id) - 1 as g, count(*) over () as n from k),
drawn as (
  select a.fact_id, s as ord, b.fact_id as d_fact, b.p_brand as d_text, 'matched' as kind from (select *, unnest(range(1, least(9, m - 1) + 1)) as s from p where m > 1) a join p b on a.p_type = b.p_type and a.p_size = b.p_size and b.at = (a.at + s) % a.m
  union all select a.fact_id, s + 10, b.fact_id, b.p_brand, 'random' from (select *, ('0x' || substr(md5(fact_id || '|random|13'), 1, 15))::bigint as start, unnest(range(0, least(9, n - 1) + 1)) as s from p where m between 2 and 9) a join p b on b.g = (a.start + s) % a.n where (a.p_type, a.p_size) <> (b.p_type, b.p_size)),
pool as (select fact_id, d_fact, d_text, kind from (select *, row_number() over (partition by fact_id order by ord) as rn from drawn) where rn <= 9
  union all select fact_id, fact_id, p_brand, 'positive' from p where m > 1),
pools as (select fact_id || '::name::0' as benchmark_id, fact_id, p_name as query_text, row_number() over (partition by fact_id order by md5(fact_id || '::name::0|' || d_fact || '|' || d_text), d_fact) - 1 as cand_idx, d_fact as cand_fact, d_text as cand_text, kind as decoy_kind from pool join k using (fact_id))
"""


def _pools(spark, d):
    return P.hard_pools(part_classes(spark, d), "name", "brand", ["type", "size"], max_candidates=10, fill_random=True)


@query(f"with {_POOLS} select benchmark_id, query_text, cand_idx, cand_fact, cand_text, decoy_kind from pools")
def hard_pools(spark, d):
    return _pools(spark, d).select("benchmark_id", "query_text", F.col("cand_idx").cast("bigint").alias("cand_idx"), "cand_fact", "cand_text", "decoy_kind")


@query(f"with {_POOLS} select benchmark_id, cand_fact, decoy_kind, row_number() over (partition by benchmark_id order by cand_idx) - 1 as cand_idx from pools where decoy_kind <> 'random'")
def matched_only_pools(spark, d):
    return P.matched_only(_pools(spark, d)).select("benchmark_id", "cand_fact", "decoy_kind", F.col("cand_idx").cast("bigint").alias("cand_idx"))


@query(f"""
with {_POOLS}, s as (select benchmark_id, count(*) as n, count(*) filter (where decoy_kind = 'matched') as matched, count(*) filter (where decoy_kind = 'random') as random from pools group by 1)
select count(*) as pools, round(avg(n), 9) as avg_candidates, min(n) as min_candidates, max(n) as max_candidates, sum(matched)::bigint as matched, sum(random)::bigint as random, count(*) filter (where random = 0) as all_hard from s
""")
def pool_composition(spark, d):
    return P.composition(_pools(spark, d))


def _tfidf_sql(texts: str, vocabulary: str, n: str = "") -> str:
    """Common table expressions: grams of ``texts`` (key, text), idf over ``vocabulary`` (text, with repeats), unit vectors vec<n>."""
    gram = "unnest(flatten(list_transform([2, 3, 4, 5], lambda n: list_transform(range(1, greatest(length(t) - n + 2, 1)), lambda i: substr(t, i::int, n))))) as gram"
    return f"""
tg{n} as (select key, gram, count(*) as tf from (select key, {gram} from (select key, ' ' || lower(text) || ' ' as t from {texts})) group by 1, 2),
vg{n} as (select distinct id, gram from (select id, {gram} from (select row_number() over () as id, ' ' || lower(text) || ' ' as t from {vocabulary}))),
idf{n} as (select gram, ln((1 + (select count(*) from {vocabulary})) / (1 + count(*))) + 1 as idf from vg{n} group by gram),
raw{n} as (select key, gram, tf * idf as w from tg{n} join idf{n} using (gram)),
norm{n} as (select key, sqrt(sum(w * w)) as norm from raw{n} group by key),
vec{n} as (select key, gram, w / norm as w from raw{n} join norm{n} using (key))
"""


_CHAT = f"""
{CONV_SQL}, q as (select form_id as key, form_id, fact_id, text from forms where notation = 'user'), c as (select form_id as key, form_id, fact_id, text from forms where notation = 'assistant'),
both_forms as (select key, text from q union all select key, text from c), both_texts as (select text from both_forms),
{_tfidf_sql('both_forms', 'both_texts')},
s as (select a.key as qk, b.key as ck, round(sum(a.w * b.w), 9) as score from vec a join vec b using (gram) where a.key in (select key from q) and b.key in (select key from c) group by 1, 2),
sc as (select q.form_id, q.fact_id, c.form_id as c_form, c.fact_id as c_fact, coalesce(score, 0) as score from q cross join c left join s on qk = q.form_id and ck = c.form_id),
rk as (select *, row_number() over (partition by form_id order by score desc, c_form) as place from sc),
ranks as (select q.form_id, q.fact_id, min(case when c_fact = q.fact_id then place end) as rank from q left join rk using (form_id) group by 1, 2)
"""


def _chat_pools(spark, d):
    forms = C.flatten(conversation_classes(spark, d))
    return R.pool(forms, ["user"]).select("form_id", "fact_id", "text"), R.pool(forms, ["assistant"]).select("form_id", "fact_id", "text")


def _chat_ranks(spark, d):
    return R.lexical_ranks(*_chat_pools(spark, d))


@query(f"with {_CHAT} select form_id, fact_id, rank from ranks")
def char_ngram_retrieval(spark, d):
    return _chat_ranks(spark, d)


@query(f"with {_CHAT} select round(avg(case when rank <= 1 then 1.0 else 0.0 end), 9) as top1, round(avg(case when rank <= 5 then 1.0 else 0.0 end), 9) as top5, round(avg(coalesce(1.0 / rank, 0)), 9) as mean_reciprocal_rank, count(*) as query_count from ranks")
def char_ngram_metrics(spark, d):
    return M.evaluate(_chat_ranks(spark, d))


def _halved(step: int) -> str:
    """Common table expressions: d<step + 1>, the draws of d<step> handed on to the halves of each range of ranks. For up to 2^5 distinct ranks."""
    return f"""
s{step} as (select b, lo, hi, (lo + hi) // 2 as mid, m, ('0x' || substr(md5(b || '|0|' || lo || '|' || hi || '|13'), 1, 13))::bigint / 4503599627370496.0 as chance from d{step} where hi - lo > 1),
n{step} as (select *, (select sum(c) from r where i >= lo and i < mid) as cl, (select sum(c) from r where i >= mid and i < hi) as cr from (select distinct lo, mid, hi, m from s{step})),
k{step} as (select *, unnest(range(greatest(0, floor(m * p - reach))::bigint, least(m, ceil(m * p + reach))::bigint + 1)) as k from (select *, cl / (cl + cr) as p, 12 * sqrt(m * (cl / (cl + cr)) * (cr / (cl + cr))) + 20 as reach from n{step})),
l{step} as (select *, sum(case when k > greatest(0, floor(m * p - reach)) then ln((m - k + 1) / k * cl / cr) else 0.0 end) over (partition by lo, hi, m order by k) as lg from k{step}),
w{step} as (select *, exp(lg - max(lg) over (partition by lo, hi, m)) as w from l{step}),
p{step} as (select lo, hi, m, k, sum(w) over (partition by lo, hi, m order by k) / sum(w) over (partition by lo, hi, m) as below from w{step}),
h{step} as (select s.b, s.lo, s.mid, s.hi, s.m, least(min(p.k) + count(*) filter (where p.below < s.chance), max(p.k)) as part from s{step} s join p{step} p using (lo, hi, m) group by 1, 2, 3, 4, 5),
d{step + 1} as (select b, lo, hi, m from d{step} where hi - lo <= 1 union all select b, lo, mid, part from h{step} union all select b, mid, hi, m - part from h{step})"""


_BOOT = f"""
with r as (select rank, count(*)::double as c, row_number() over (order by rank nulls first) - 1 as i from (select nullif(label, 0) as rank from embeddings) group by 1),
d0 as (select b, 0 as lo, (select count(*) from r) as hi, (select count(*) from embeddings) as m from range(1000) t(b)), {", ".join(map(_halved, range(5)))},
mm as (select b, round(sum(case when rank <= 1 then m else 0 end) / sum(m), 9) as top1, round(sum(case when rank <= 5 then m else 0 end) / sum(m), 9) as top5, round(sum(coalesce(m / rank::double, 0)) / sum(m), 9) as rr from d5 join r on i = lo group by b)
select round(quantile_cont(top1, 0.025), 9) as top1_ci_low, round(quantile_cont(top1, 0.975), 9) as top1_ci_high, round(quantile_cont(top5, 0.025), 9) as top5_ci_low, round(quantile_cont(top5, 0.975), 9) as top5_ci_high,
  round(quantile_cont(rr, 0.025), 9) as mean_reciprocal_rank_ci_low, round(quantile_cont(rr, 0.975), 9) as mean_reciprocal_rank_ci_high, 0.95::double as confidence_level, count(*) as bootstrap_resamples from mm
"""


@query(_BOOT)
def bootstrap_intervals(spark, d):
    return M.bootstrap(table(spark, d, "embeddings").select("vec_id", F.nullif(F.col("label"), F.lit(0)).alias("rank")))


_NAMES = _tfidf_sql("(select p_partkey as key, p_name as text from part)", "(select p_name as text from part)")


@query(f"with {_NAMES} select gram, round(idf, 9) as idf from idf")
def gram_idf(spark, d):
    return R.idf([table(spark, d, "part").select(F.col("p_name").alias("text"))]).select("gram", F.round("idf", 9).alias("idf"))


@query(f"with {_NAMES} select key as p_partkey, count(*) as grams, round(sum(w), 6) as total, round(max(w), 9) as top from vec group by 1")
def tfidf_vectors(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("text"))
    vec = R.tfidf(rows, R.idf([rows]), "p_partkey")
    return vec.select("p_partkey", F.size("g").cast("bigint").alias("grams"), F.round(F.aggregate("w", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.array_max("w"), 9).alias("top"))


@query(f"""
with q as (select item_id, text from benchmark), c as (select page_id, url as text from pages),
kf as (select 'b' || item_id as key, text from q union all select 'p' || page_id, text from c), kt as (select text from kf), {_tfidf_sql('kf', 'kt')},
s as (select a.key as q_form, b.key as c_form, round(sum(a.w * b.w), 9) as score from vec a join vec b using (gram) where a.key like 'b%' and b.key like 'p%' group by 1, 2),
f as (select 'b' || item_id as q_form, 'p' || page_id as c_form from q cross join c),
r as (select q_form, c_form, coalesce(score, 0)::double as score, row_number() over (partition by q_form order by coalesce(score, 0) desc, c_form) as rank from f left join s using (q_form, c_form))
select q_form, c_form, score, rank from r where rank <= 5
""")
def sparse_top_k(spark, d):
    q = table(spark, d, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("form_id"), "text")
    c = table(spark, d, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("form_id"), F.col("url").alias("text"))
    w = R.idf([q, c])
    vec = lambda x: R.with_vectors(x, w).select("form_id", F.col("form_id").alias("idx"), "g", "w")
    return R.scored(vec(q), vec(c), 0.0, 5).withColumn("rank", F.col("rank").cast("bigint"))


@query(f"""
with {PART_SQL}, q as (select * from forms where notation = 'name'), c as (select * from forms where notation = 'brand'),
n as (select *, row_number() over (order by form_id) as place, row_number() over (partition by p_size order by form_id) as in_key, count(*) over (partition by p_size) as size from c),
near as (select p_size, p_type, min(in_key) as near from n group by 1, 2), far as (select p_type, min(place) as place from n group by 1),
own as (select q.form_id, count(*) filter (where n.place < far.place) as before, count(*) as size from q join far using (p_type) left join n on n.p_size = q.p_size group by 1)
select q.form_id, coalesce(near.near, far.place + own.size - own.before)::bigint as rank from q left join near using (p_size, p_type) left join far using (p_type) left join own using (form_id)
""")
def canonical_ranks(spark, d):
    forms = C.flatten(S.require_attr(part_classes(spark, d), "size")).withColumn("size", S.attr("size")).withColumn("type", S.attr("type"))
    return R.canonical_ranks(forms.filter("notation = 'name'"), forms.filter("notation = 'brand'"), "size", "type")


_VEC = "e as (select lpad(vec_id::varchar, 9, '0') as form_id, label::varchar as fact_id, vec_id, embedding from embeddings), q as (select * from e), c as (select * from e)"
_DENSE = f"""
{_VEC}, sc as (select q.form_id, q.fact_id, c.form_id as c_form, c.fact_id as c_fact, round(list_dot_product(q.embedding::double[], c.embedding::double[]), 9) as score from q cross join c where q.form_id <> c.form_id),
rk as (select *, row_number() over (partition by form_id order by score desc, c_form) as place from sc),
ranks as (select form_id, any_value(fact_id) as fact_id, min(case when c_fact = fact_id then place end) as rank from rk group by form_id)
"""


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.lpad(F.col("vec_id").cast("string"), 9, "0").alias("form_id"), F.col("label").cast("string").alias("fact_id"), "vec_id", F.col("embedding").alias("dense"))


@query(f"with {_DENSE} select form_id, fact_id, rank from ranks")
def dense_retrieval(spark, d):
    v = _vectors(spark, d).drop("vec_id")
    return R.dense_ranks(v, v)


_MIX = f"""
{_VEC.replace("embedding from embeddings", "embedding, p_name as text from embeddings join part on p_partkey = vec_id % (select max(p_partkey) from part) + 1")}, kf as (select form_id as key, text from e), kt as (select text from q union all select text from c), {_tfidf_sql('kf', 'kt')},
s as (select a.key as qk, b.key as ck, sum(a.w * b.w) as score from vec a join vec b using (gram) where a.key in (select form_id from q) group by 1, 2),
sc as (select q.form_id, q.fact_id, c.form_id as c_form, c.fact_id as c_fact, round(0.3 * coalesce(s.score, 0) + 0.7 * list_dot_product(q.embedding::double[], c.embedding::double[]), 9) as score from q cross join c left join s on qk = q.form_id and ck = c.form_id where q.form_id <> c.form_id),
rk as (select *, row_number() over (partition by form_id order by score desc, c_form) as place from sc)
"""


def _named_vectors(spark, d):
    """Every vector with the name of a part."""
    p = table(spark, d, "part")
    v = _vectors(spark, d).join(F.broadcast(p.agg(F.max("p_partkey").alias("_n"))))  # one row
    named = p.select(F.col("p_partkey").alias("_p"), F.col("p_name").alias("text"))
    return v.hint("merge").join(named, F.col("vec_id") % F.col("_n") + 1 == F.col("_p")).drop("_p", "_n", "vec_id")


@query(f"with {_MIX} select form_id, any_value(fact_id) as fact_id, min(case when c_fact = fact_id then place end) as rank from rk group by form_id")
def hybrid_retrieval(spark, d):
    v = _named_vectors(spark, d)
    return R.hybrid_ranks(v, v)


_HARD = f"""
{_POOLS}, qd as (select distinct benchmark_id, query_text from pools), vt as (select query_text as text from qd union all select cand_text from pools), kf as (select distinct text as key, text from vt), {_tfidf_sql('kf', 'vt')},
pr as (select distinct query_text, cand_text from pools),
s as (select query_text, cand_text, round(sum(a.w * b.w), 9) as score from pr join vec a on a.key = query_text join vec b on b.key = cand_text and a.gram = b.gram group by 1, 2),
rk as (select benchmark_id, decoy_kind, row_number() over (partition by benchmark_id order by coalesce(score, 0) desc, cand_idx) as place from pools left join s using (query_text, cand_text)),
hard as (select benchmark_id, min(case when decoy_kind = 'positive' then place end) as rank from rk group by 1)
"""


@query(f"with {_HARD} select benchmark_id, rank from hard")
def hard_lexical_retrieval(spark, d):
    return R.hard_lexical_ranks(_pools(spark, d))


_EVAL = "round(avg(case when rank <= 1 then 1.0 else 0.0 end), 9) as top1, round(avg(case when rank <= 5 then 1.0 else 0.0 end), 9) as top5, round(avg(coalesce(1.0 / rank, 0)), 9) as mean_reciprocal_rank, count(*) as query_count"


#: Every vector has a notation by its number: one of candidates, three of queries, each a task with its own idf.
TASKS = ["approved", "alias", "previous", "name"]


def _task_sql(t: int) -> str:
    """Common table expressions: r<t>(method, rank), the ranks of one task by each method."""
    scores = {"char_ngram": "coalesce(s.score, 0)", "dense": "dot", "hybrid": "0.3 * coalesce(s.score, 0) + 0.7 * dot"}
    ranked = " union all ".join(f"select '{m}' as method, form_id, c_fact = fact_id as hit, row_number() over (partition by form_id order by round({x}, 9) desc, c_form) as place from sc{t} s" for m, x in scores.items())
    return f"""
q{t} as (select * from e where vec_id % 4 = {t}), kf{t} as (select form_id as key, text from q{t} union all select form_id, text from c0), kt{t} as (select text from kf{t}), {_tfidf_sql(f"kf{t}", f"kt{t}", str(t))},
s{t} as (select a.key as qk, b.key as ck, sum(a.w * b.w) as score from vec{t} a join vec{t} b using (gram) where a.key in (select form_id from q{t}) and b.key in (select form_id from c0) group by 1, 2),
sc{t} as (select q.form_id, q.fact_id, c.form_id as c_form, c.fact_id as c_fact, s.score, list_dot_product(q.embedding::double[], c.embedding::double[]) as dot from q{t} q cross join c0 c left join s{t} s on qk = q.form_id and ck = c.form_id),
k{t} as ({ranked} union all select 'canonical', q.form_id, c.fact_id = q.fact_id, row_number() over (partition by q.form_id order by q.key <> c.key, c.form_id) from q{t} q cross join c0 c),
r{t} as (select '{TASKS[t]}' as task, method, q.form_id, min(case when hit then place end) as rank from k{t} right join (select form_id, unnest(['char_ngram', 'dense', 'hybrid', 'canonical']) as method from q{t}) q using (form_id, method) group by 1, 2, 3)"""


@query(f"""
with e as (select lpad(vec_id::varchar, 9, '0') as form_id, label::varchar as fact_id, vec_id, (vec_id // 4) % 25 as key, embedding, p_name as text from embeddings join part on p_partkey = vec_id % (select max(p_partkey) from part) + 1),
c0 as (select * from e where vec_id % 4 = 0), {", ".join(map(_task_sql, (1, 2, 3)))}
select task, method, {_EVAL} from (select * from r1 union all select * from r2 union all select * from r3) group by 1, 2
""")
def method_comparison(spark, d):
    """Three query notations against one pool of candidates by four methods: all ranks but the canonical ones come from one run over the blocks of candidates."""
    v = _named_vectors(spark, d).withColumn("number", F.col("form_id").cast("long"))
    v = materialize(v.select("form_id", "fact_id", "text", "dense", (F.col("number") % 4).cast("int").alias("task"), F.floor(F.col("number") / 4 % 25).alias("key")), "vectors")
    pool, queries, sides, weights = v.filter("task = 0"), [], [], []
    for t in (1, 2, 3):
        q = v.filter(F.col("task") == t)
        weights.append(G.gram_idf([q, pool]).withColumn("ws", F.lit(t)))
        # A form of the pool has other weights in each task: it stands once for each.
        shown = lambda df, t=t: df.select(F.concat(F.lit(f"{t}|"), "form_id").alias("form_id"), "fact_id", F.coalesce("text", F.lit("")).alias("text"), "dense", F.lit(t).alias("ws"))
        queries.append(shown(q).withColumn("task", F.lit(t)))
        sides.append(shown(pool).withColumn("serves", F.array(F.lit(t))))
    q, c, held = (reduce(DataFrame.unionByName, side) for side in (queries, sides, weights))
    ranks = first_match(q, c, [0.0, 1.0, 0.7], n_tasks=4, weights=materialize(held, "weights"))
    rows = ranks.select("task", F.posexplode("ranks").alias("m", "rank")).select("task", F.element_at(F.array(*map(F.lit, ("char_ngram", "dense", "hybrid"))), F.col("m") + 1).alias("method"), "rank")
    rows = rows.unionByName(ranks.filter("ranks is null").select("task", F.explode(F.array(*map(F.lit, ("char_ngram", "dense", "hybrid")))).alias("method"), F.lit(None).cast("long").alias("rank")))
    canonical = R.canonical_ranks(v.filter("task > 0"), pool, "key", "fact_id").join(v.select("form_id", "task"), "form_id")
    rows = rows.unionByName(canonical.select("task", F.lit("canonical").alias("method"), "rank"))
    mean = lambda c: F.round(F.avg(c), 9)
    names = F.element_at(F.array(*map(F.lit, TASKS)), F.col("task") + 1).alias("task")
    return M.per_query(rows).groupBy(names, "method").agg(mean("top1").alias("top1"), mean("top5").alias("top5"), mean("rr").alias("mean_reciprocal_rank"), F.count("*").alias("query_count"))


@query("""
with e as (select vec_id, label, embedding, (row_number() over (order by vec_id) - 1) // 128 as batch from embeddings),
s as (select a.vec_id as row, b.vec_id as r_row, a.label = b.label as hit, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 9) as score from e a join e b on a.vec_id // 128 = b.vec_id // 128),
r as (select *, row_number() over (partition by row order by score desc, r_row) as place from s)
select row, min(case when hit then place end) as rank from r group by row
""")
def in_batch_ranks(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), F.col("label").alias("fact_id"), F.col("embedding").alias("l"), F.col("embedding").alias("r"))
    return R.batch_ranks(e)


_INV = """
e as (select label::varchar as fact_id, lpad(vec_id::varchar, 9, '0') as form_id, embedding::double[] as v from embeddings),
w as (select a.fact_id, a.form_id as i, b.form_id as j, 1 - list_dot_product(a.v, b.v) as distance from e a join e b on a.fact_id = b.fact_id and a.form_id < b.form_id),
x as (select fact_id, unnest(v) as x, unnest(range(64)) as d from e), m as (select fact_id, d, avg(x) as x from x group by 1, 2), nm as (select fact_id, sqrt(sum(x * x)) as norm from m group by 1),
cc as (select fact_id, list(x / norm order by d) as c from m join nm using (fact_id) group by 1),
b as (select 1 - list_dot_product(p.c, q.c) as distance from cc p join cc q on p.fact_id < q.fact_id)
"""


def _forms_with_vectors(spark, d):
    return _vectors(spark, d).drop("vec_id")


@query(f"""
with {_INV} select (select count(distinct fact_id) from e) as fact_count, (select count(*) from e) as form_count, (select count(*) from w) as within_pair_count, (select count(*) from b) as between_pair_count,
  round((select avg(distance) from w), 9) as mean_within_cosine_distance, round((select avg(distance) from b), 9) as mean_between_cosine_distance, round((select avg(distance) from b) / (select avg(distance) from w), 9) as invariance_ratio
""")
def invariance_ratio(spark, d):
    return M.invariance(_forms_with_vectors(spark, d))


@query("""
with e as (select (vec_id % 200)::varchar as fact_id, embedding::double[] as v from embeddings), x as (select fact_id, unnest(v) as x, unnest(range(64)) as d from e),
m as (select fact_id, d, avg(x) as x from x group by 1, 2), nm as (select fact_id, sqrt(sum(x * x)) as norm from m group by 1), cc as (select fact_id, list(x / norm order by d) as c from m join nm using (fact_id) group by 1),
p as (select fact_id, c, row_number() over (order by md5(fact_id || '|13'), fact_id) - 1 as at, count(*) over () as n from cc),
t as (select ((2305843009213693951::hugeint % (n * (n - 1) // 2)) * k + 13) % (n * (n - 1) // 2) as t from (select any_value(n) as n from p), range(10000) r(k)),
ij as (select t, floor((1 + sqrt(1 + 8 * t::double)) / 2)::bigint as j from t)
select i.fact_id as i, j.fact_id as j, round(1 - list_dot_product(i.c, j.c), 9) as distance from ij join p j on j.at = ij.j join p i on i.at = ij.t - ij.j * (ij.j - 1) // 2
""")
def sampled_between_distances(spark, d):
    """Exactly 10,000 of the 19,900 pairs of 200 facts."""
    forms = table(spark, d, "embeddings").select((F.col("vec_id") % 200).cast("string").alias("fact_id"), F.col("embedding").alias("dense"))
    return M.between_distances(M.centroids(forms)).select("i", "j", F.round("distance", 9).alias("distance"))


@query(f"with {_INV} select fact_id, count(*) as pairs, round(avg(distance), 9) as mean, round(min(distance), 9) as least, round(max(distance), 9) as most from w group by 1")
def within_distances(spark, d):
    w = M.within_extremes(_forms_with_vectors(spark, d))
    return w.select("fact_id", "pairs", *(F.round(c, 9).alias(c) for c in ("mean", "least", "most")))


@query(f"with {_INV} select fact_id, round(c[1], 9) as first, round(c[64], 9) as last, round(list_sum(c), 8) as total from cc")
def class_centroids(spark, d):
    c = M.centroids(_forms_with_vectors(spark, d))
    return c.select("fact_id", F.round(F.get("c", F.lit(0)), 9).alias("first"), F.round(F.get("c", F.lit(63)), 9).alias("last"), F.round(F.aggregate("c", F.lit(0.0), lambda a, x: a + x), 8).alias("total"))


@query("""
with b as (select p_partkey as pair, unnest(range(1, length(p_brand) + 1)) as i, p_brand, p_name from part),
s as (select pair, i, ascii(substr(p_brand, i::int, 1)) as s, p_name from b), t as (select *, unnest(range(1, length(p_name) + 1)) as j from s),
w as (select pair, i, j, (case when s = ascii(substr(p_name, j::int, 1)) then 2.0 else 0 end + case when s between 48 and 57 and ascii(substr(p_name, j::int, 1)) between 48 and 57 then 1.0 else 0 end)::double as w from t),
p as (select *, sum(w) over (partition by pair, i) as total, count(*) over (partition by pair, i) as n from w)
select pair, (i - 1)::int as i, round(sum(case when total > 0 then w / total else 1.0 / n end), 9) as mass, round(max(case when total > 0 then w / total else 1.0 / n end), 9) as top, count(*) as targets from p group by 1, 2
""")
def teacher_distribution(spark, d):
    from lexiform.functions.text import byte_ids

    pairs = table(spark, d, "part").select(F.col("p_partkey").alias("pair"), byte_ids(F.col("p_brand"), 64).alias("source"), byte_ids(F.col("p_name"), 64).alias("target"))
    return X.teacher_rows(pairs).select("pair", "i", F.round("mass", 9).alias("mass"), F.round("top", 9).alias("top"), "targets")


_LOGITS = """
z as (select a.vec_id // 128 as batch, a.vec_id as i, b.vec_id as j, list_dot_product(a.embedding::double[], b.embedding::double[]) / 0.07 as z, a.label = b.label as positive from embeddings a join embeddings b on a.vec_id // 128 = b.vec_id // 128)
"""


def _logits(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), F.col("label").alias("fact_id"), F.col("embedding").alias("v"))
    return L.logits(e, e)


@query(f"""
with {_LOGITS}, li as (select *, z - ln(sum(exp(z)) over (partition by batch, i)) as lp, z - ln(sum(exp(z)) over (partition by batch, j)) as lq from z),
a as (select batch, i, -sum(case when positive then lp else 0 end) / greatest(count(*) filter (where positive), 1) as l from li group by 1, 2), b as (select batch, j, -sum(case when positive then lq else 0 end) / greatest(count(*) filter (where positive), 1) as l from li group by 1, 2)
select batch, round((avg(a.l) + (select avg(b.l) from b where b.batch = a.batch)) / 2, 8) as loss from a group by batch
""")
def contrastive_loss(spark, d):
    return L.contrastive(_logits(spark, d)).select("batch", F.round("loss", 8).alias("loss"))


@query(f"""
with {_LOGITS}, li as (select *, z - ln(sum(exp(z)) over (partition by batch, i)) as lp from z where i <> j), a as (select batch, i, -sum(case when positive then lp end) / nullif(count(*) filter (where positive), 0) as l from li group by 1, 2)
select batch, round(coalesce(avg(l), 0), 8) as loss from a group by batch
""")
def supervised_contrastive_loss(spark, d):
    return L.supervised_contrastive(_logits(spark, d)).select("batch", F.round("loss", 8).alias("loss"))


@query("""
with r as (select vec_id, label % 4 as label, (embedding::double[])[1:4] as s from embeddings), t as (select *, list_max(s) as top from r)
select round(avg(top + ln(list_sum(list_transform(s, lambda x: exp(x - top)))) - s[label + 1]), 9) as loss, round(avg(case when list_position(s, top) - 1 = label then 1.0 else 0.0 end), 9) as accuracy from t
""")
def attribute_loss(spark, d):
    e = table(spark, d, "embeddings").select((F.col("label") % 4).alias("label"), F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")).alias("scores"))
    return L.attribute_loss(e).select(F.round("loss", 9).alias("loss"), F.round("accuracy", 9).alias("accuracy"))


@query("select round((avg((l_discount - l_tax)**2) + avg((l_quantity / 1000 - l_tax)**2) + avg((l_discount - l_quantity / 1000)**2)) / 3, 9) as loss, round((avg(abs(l_discount - l_tax)) + avg(abs(l_quantity / 1000 - l_tax))) / 2, 9) as mae from lineitem where l_linenumber % 3 <> 0")
def numeric_consistency_loss(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_discount").alias("l"), (F.col("l_quantity") / 1000).alias("r"), F.col("l_tax").alias("value"), F.when(F.col("l_linenumber") % 3 == 0, 0).otherwise(1).alias("present"))
    return L.numeric_consistency(rows).select(F.round("loss", 9).alias("loss"), F.round("mae", 9).alias("mae"))


@query(f"with {_POOLS}, z as (select *, length(cand_text) / 10.0 + cand_idx / 100.0 as z from pools) select benchmark_id, round(ln(sum(exp(z))) - ln(sum(exp(z)) filter (where decoy_kind = 'positive')), 8) as loss from z group by 1")
def hard_pool_loss(spark, d):
    z = _pools(spark, d).select("benchmark_id", (F.length("cand_text") / 10 + F.col("cand_idx") / 100).alias("z"), (F.col("decoy_kind") == "positive").alias("positive"))
    return L.hard_pool_loss(z).select("benchmark_id", F.round("loss", 8).alias("loss"))


@query(f"""
with {_POOLS}, z as (select *, length(cand_text) / 10.0 + cand_idx / 100.0 as z from pools),
l as (select benchmark_id, ln(sum(exp(z))) - ln(sum(exp(z)) filter (where decoy_kind = 'positive')) as loss from z group by 1),
r as (select benchmark_id, min(place) filter (where decoy_kind = 'positive') as rank from (select *, row_number() over (partition by benchmark_id order by z desc, cand_idx) as place from z) group by 1)
select round(avg(loss), 8) as loss, round(avg(rank), 9) as mean_rank, round(avg(case when rank <= 1 then 1.0 else 0 end), 9) as top1, round(avg(case when rank <= 5 then 1.0 else 0 end), 9) as top5, round(avg(1.0 / rank), 9) as mean_reciprocal_rank, count(*) as pools
from l join r using (benchmark_id)
""")
def hard_pool_evaluation(spark, d):
    """The evaluation step over hard pools: rank metrics beside the loss."""
    z = _pools(spark, d).select("benchmark_id", "cand_idx", (F.length("cand_text") / 10 + F.col("cand_idx") / 100).alias("z"), (F.col("decoy_kind") == "positive").alias("positive"))
    out = L.hard_pool_evaluation(z)
    return out.select(F.round("loss", 8).alias("loss"), *(F.round(c, 9).alias(c) for c in ("mean_rank", "top1", "top5", "mean_reciprocal_rank")), "pools")


@query("select event_type, round(avg(value), 6) as value from events group by 1")
def batch_history(spark, d):
    return L.history(table(spark, d, "events"), ["event_type"], ["value"]).select("event_type", F.round("value", 6).alias("value"))


@query("""select '{"n":' || count(*) || ',"top":"' || max(r_name) || '"}' as metrics from region""")
def metrics_as_json(spark, d):
    return files.metrics_json(table(spark, d, "region").agg(F.count("*").alias("n"), F.max("r_name").alias("top")))


@query()
def encoder_forward(spark, d):
    """Vectors of all conversation texts by the convolutional and the attention encoder (seeded weights): their sums, and the norms of both."""
    p = table(spark, d, "conversations").select("conv_id", "turn", "text")
    out = E.encode(p, E.ConvEncoder()).withColumnRenamed("dense", "conv")
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 6)
    out = E.encode(out, E.AttentionEncoder()).select("conv_id", "turn", total("conv").alias("conv_sum"), F.round(M.dot(F.col("conv"), F.col("conv")), 6).alias("conv_norm"), total("dense").alias("attention_sum"), F.round(M.dot(F.col("dense"), F.col("dense")), 6).alias("attention_norm"))
    return out


_RUNS = {"first": "turn % 2 = 0", "second": "turn <= 1", "first again": "turn % 2 = 0", "all": "true"}


@query(" union all ".join(
    f"select '{run}' as run, count(*) as rows, (select count(*) from (select distinct text from conversations where {' or '.join(list(_RUNS.values())[: i + 1])})) as entries, count(*) filter (where coalesce(text, '') = '') as without from conversations where {test}"
    for i, (run, test) in enumerate(_RUNS.items())
))
def encoder_cache(spark, d):
    """Interleaved and repeated runs over one cache: rows, entries of the cache behind each run, and rows without a vector of unit length."""
    path, turns, out = new_path(spark, "cache"), table(spark, d, "conversations").select("turn", "text"), []
    for run, test in _RUNS.items():
        rows = E.cached_encode(turns.filter(test).select("text"), E.MeanEncoder(), path, "mean")
        unit = F.coalesce(F.abs(M.dot(F.col("dense"), F.col("dense")) - 1) < 1e-6, F.lit(False))
        told = rows.agg(F.count("*").alias("rows"), F.count_if(~unit).alias("without")).join(spark.read.parquet(path).agg(F.count("*").alias("entries")))  # single rows
        out.append(materialize(told.select(F.lit(run).alias("run"), "rows", "entries", "without"), "run"))  # before the next run changes the cache
    return reduce(DataFrame.unionByName, out)


@query()
def student_retrieval(spark, d):
    """A student fitted on (brand, type) pairs, then dense first-match ranks of types among brands."""
    forms = C.flatten(part_classes(spark, d)).select("form_id", "fact_id", "notation", "text")
    model = E.fit_student(P.pairs_of_classes(part_classes(spark, d), "type", "brand"))
    enc = lambda n: E.encode(forms.filter(F.col("notation") == n).drop("notation"), model)
    return R.dense_ranks(enc("type").drop("text"), enc("brand").drop("text"))


@query()
def hard_student_retrieval(spark, d):
    """The same student over hard pools: rank of the positive by dot product, then metrics."""
    model = E.fit_student(P.pairs_of_classes(part_classes(spark, d), "name", "brand"))
    pools = _pools(spark, d)
    texts = pools.select(F.col("query_text").alias("text")).unionByName(pools.select(F.col("cand_text").alias("text"))).distinct()
    vec = E.encode(texts, model)
    q, c = vec.select(F.col("text").alias("query_text"), F.col("dense").alias("x")), vec.select(F.col("text").alias("cand_text"), F.col("dense").alias("y"))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("benchmark_id").orderBy(F.desc("score"), "cand_idx"))
    rows = pools.join(q.hint("merge"), "query_text").join(c.hint("merge"), "cand_text").withColumn("score", F.round(M.dot(F.col("x"), F.col("y")), 9)).withColumn("place", place)
    return M.evaluate(rows.groupBy("benchmark_id").agg(F.min(F.when(F.col("decoy_kind") == "positive", F.col("place"))).alias("rank")))


@query("""
with b as (select p_partkey as pair, unnest(range(1, length(p_brand) + 1)) as i, p_brand, p_name from part),
s as (select pair, i, ascii(substr(p_brand, i::int, 1)) as s, p_name from b), t as (select *, unnest(range(1, length(p_name) + 1)) as j from s),
w as (select pair, i, j, (case when s = ascii(substr(p_name, j::int, 1)) then 2.0 else 0 end + case when s between 48 and 57 and ascii(substr(p_name, j::int, 1)) between 48 and 57 then 1.0 else 0 end)::double as w from t),
p as (select pair, i, case when sum(w) over (partition by pair, i) > 0 then w / sum(w) over (partition by pair, i) else 1.0 / count(*) over (partition by pair, i) end as p, count(*) over (partition by pair, i) as n from w),
k as (select pair, i, sum(case when p > 0 then p * (ln(p) - ln(1.0 / n)) else 0 end) as kl from p group by 1, 2)
select pair, round(avg(kl), 8) as loss from k group by pair
""")
def attention_distillation_loss(spark, d):
    """Divergence of a uniform student from the byte teacher."""
    from lexiform.functions.text import byte_ids

    ids = lambda c: F.filter(byte_ids(F.col(c), 64), lambda x: x > 0)
    pairs = spread(table(spark, d, "part").select(F.col("p_partkey").alias("pair"), "p_brand", "p_name")).select("pair", ids("p_brand").alias("source"), ids("p_name").alias("target"))
    uniform = F.transform("source", lambda s: F.transform("target", lambda t: F.lit(1.0) / F.size("target")))
    return pairs.select("pair", F.round(X.teacher_divergence("source", "target", uniform), 8).alias("loss"))


@query(f"""
with {_POOLS}, f as (select distinct benchmark_id, fact_id from pools union all select benchmark_id, cand_fact from pools), v as (select p_size::double as v from f join part on p_partkey::varchar = f.fact_id)
select 'size' as field, min(v) as low, max(v) as high, greatest(max(v) - min(v), 1.0) as scale from v
""")
def hard_pool_numeric_stats(spark, d):
    return X.numeric_stats(X.hard_attributes(_pools(spark, d), part_classes(spark, d).select("fact_id", "attrs")), ["size"], strict=True)


@query(f"with {CONV_SQL} select form_id from (select form_id, row_number() over (order by form_id) as rn from forms where notation in ('user', 'system')) where rn <= 50")
def capped_pool(spark, d):
    """A prefix of a pool in its order: max_queries and max_candidates."""
    return R.pool(C.flatten(conversation_classes(spark, d)), ["user", "system"], track="chat", limit=50).select("form_id")


@query("select event_type, time_bucket(interval '1 day', ts) as start, count(*) as n from events group by 1, 2")
def streamed_windows(spark, d):
    """Daily counts from a stream over the events, as its last complete result."""
    from lexiform.streaming.forms import windowed_counts

    out = new_path(spark, "stream")
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    # Watermarks need instants: the table's clock time is read as UTC, whatever the session's zone.
    stream = stream.withColumn("ts", F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', cast(ts as timestamp_ntz))")))
    counts = windowed_counts(stream, "ts", "event_type", "1 day", "36500 days")
    q = counts.writeStream.outputMode("complete").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/rows")).start()
    q.awaitTermination()
    start = F.expr("timestampadd(MICROSECOND, unix_micros(start), timestamp_ntz'1970-01-01')").alias("start")
    return spark.read.parquet(f"{out}/rows").select("event_type", start, "n")

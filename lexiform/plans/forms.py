"""Queries over sources, scalar functions, classes, filters and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiform.functions import text as T
from lexiform.operators import classes as C
from lexiform.operators import features as X
from lexiform.operators import splits as S
from lexiform.operators.skew import spread
from lexiform.plans.base import CONV_SQL, PART_SQL, attrs, conversation_classes, part_classes, query, table
from lexiform.sources import files, registry


@query(f"with {CONV_SQL} select form_id, fact_id, track, notation, text from forms")
def flatten_forms(spark, d):
    return C.flatten(conversation_classes(spark, d)).select("form_id", "fact_id", "track", "notation", "text")


@query("""
with c as (
  select p_partkey, unnest([p_name, p_brand, p_type, p_brand, ' ' || p_name || ' ', '"' || p_type || '"', '']) as raw, unnest(['name', 'brand', 'type', 'alias', 'prev', 'quoted', 'empty']) as notation, unnest([1,2,3,4,5,6,7]) as pos from part),
k as (select p_partkey, trim(trim(raw), '"') as text, notation, pos from c),
f as (select *, row_number() over (partition by p_partkey, text order by pos) as rn from k where text <> '')
select p_partkey::varchar || '::' || (row_number() over (partition by p_partkey order by pos) - 1) as form_id, p_partkey::varchar as fact_id, notation, text from f where rn = 1
""")
def unique_forms(spark, d):
    one = lambda c, n: F.struct(c.alias("text"), F.lit(n).alias("notation"))
    p = table(spark, d, "part")
    cands = F.array(
        one(F.col("p_name"), "name"), one(F.col("p_brand"), "brand"), one(F.col("p_type"), "type"), one(F.col("p_brand"), "alias"),
        one(F.concat(F.lit(" "), "p_name", F.lit(" ")), "prev"), one(F.concat(F.lit('"'), "p_type", F.lit('"')), "quoted"), one(F.lit(""), "empty"),
    )
    return C.flatten(C.with_forms(p.select(F.col("p_partkey").cast("string").alias("fact_id"), "*"), cands).select("fact_id", "forms")).select("form_id", "fact_id", "notation", "text")


@query("select doc_id, md5(text) as text_md5 from (select *, row_number() over (partition by text order by doc_id) as rn from documents) where rn = 1")
def first_wins_dedup(spark, d):
    return C.first_rows(table(spark, d, "documents").select("text", "doc_id"), ["text"], [F.col("doc_id")]).select("doc_id", F.md5("text").alias("text_md5"))


@query("""
with j as (select c_custkey, c_name, n_name, r_name, c_mktsegment from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey),
c as (select c_custkey, unnest(['customer:' || c_custkey, c_name, n_name, r_name, c_mktsegment]) as text, unnest(['id', 'name', 'nation', 'region', 'segment']) as notation, unnest([1,2,3,4,5]) as pos from j)
select 'customer:' || c_custkey || '::' || (row_number() over (partition by c_custkey order by pos) - 1) as form_id, notation, text from c where coalesce(text, '') <> ''
""")
def join_class_builder(spark, d):
    c, n, r = table(spark, d, "customer"), table(spark, d, "nation"), table(spark, d, "region")
    j = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, F.col("n_regionkey") == r.r_regionkey, "left")
    fact = F.concat(F.lit("customer:"), F.col("c_custkey").cast("string"))
    cands = F.concat(C.form(fact, "id"), C.form(F.col("c_name"), "name"), C.form(F.col("n_name"), "nation"), C.form(F.col("r_name"), "region"), C.form(F.col("c_mktsegment"), "segment"))
    return C.flatten(C.with_forms(j.withColumn("fact_id", fact), cands).select("fact_id", "forms").filter(F.size("forms") >= 3)).select("form_id", "notation", "text")


@query("""
with m as (select user_id, event_type, ts, event_id, case when event_type is not distinct from lag(event_type) over w and row_number() over w > 1 then 0 else 1 end as fresh from events window w as (partition by user_id order by ts, event_id)),
r as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as run from m)
select user_id, run::bigint as run, min(event_type) as event_type, count(*) as n, min(event_id) as first_event from r group by user_id, run
""")
def consecutive_runs(spark, d):
    r = C.runs(table(spark, d, "events").select("user_id", "event_type", "ts", "event_id"), "event_type", [F.col("ts"), F.col("event_id")], ["user_id"])
    return r.groupBy("user_id", F.col("run").cast("bigint").alias("run")).agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("""
select l_orderkey, string_agg(distinct l_returnflag, '|' order by l_returnflag) as flags, string_agg(distinct l_linestatus, '|' order by l_linestatus) as statuses, min(l_quantity) as least_quantity,
  min(l_quantity) filter (where l_returnflag = 'R') as least_returned, arg_min(l_partkey, l_linenumber::bigint * 1000000000 + l_partkey) as first_part, count(*) as n
from lineitem group by l_orderkey having count(*) >= 2
""")
def grouped_class_attributes(spark, d):
    s = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "|")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        s("l_returnflag").alias("flags"), s("l_linestatus").alias("statuses"), F.min("l_quantity").alias("least_quantity"),
        F.min(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("least_returned"), F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("first_part"), F.count("*").alias("n"),
    ).filter("n >= 2")


#: An HGNC-shaped table made of parts.
def _genes(spark, d):
    p, t = table(spark, d, "part"), lambda c: F.col(c)
    return p.select(
        F.struct(F.lit("part").alias("file"), F.col("p_partkey").alias("row")).alias("ord"), F.concat(F.lit("HGNC:"), t("p_partkey").cast("string")).alias("hgnc_id"), t("p_brand").alias("symbol"), t("p_name").alias("name"),
        t("p_type").alias("locus_group"), F.lit("").alias("locus_type"), F.lit("Approved").alias("status"), F.lit(None).cast("string").alias("location"),
        F.concat("p_brand", F.lit("| S"), t("p_size").cast("string"), F.lit(" ||"), "p_type").alias("alias_symbol"), F.lit("").alias("alias_name"), F.concat(F.lit('"'), "p_name", F.lit('"')).alias("prev_symbol"),
        F.lit(None).cast("string").alias("prev_name"), F.lit("-").alias("refseq_accession"), F.lit("na").alias("uniprot_ids"), F.lit("").alias("mane_select"), t("p_partkey").cast("string").alias("entrez_id"), F.lit("").alias("ensembl_gene_id"),
    )


_GENES_SQL = """
raw as (select p_partkey as k, unnest([p_brand, p_name, '', p_partkey::varchar, p_brand, 'S' || p_size, p_type, p_name, '-', 'na']) as text,
  unnest(['approved_symbol', 'approved_name', 'ensembl_gene_id', 'entrez_gene_id', 'alias_symbol', 'alias_symbol', 'alias_symbol', 'prev_symbol', 'refseq_accession', 'uniprot_ids']) as notation, unnest(range(1, 11)) as pos, p_brand from part),
f as (select *, row_number() over (partition by k, text order by pos) as rn from raw where text <> '')
"""


@query(f"with {_GENES_SQL} select 'gene:HGNC:' || k || ':' || p_brand as fact_id, notation, text, row_number() over (partition by k order by pos) - 1 as pos from f where rn = 1")
def gene_alias_classes(spark, d):
    return C.flatten(C.hgnc_classes(_genes(spark, d))).select("fact_id", "notation", "text", F.col("pos").cast("bigint").alias("pos"))


@query("""
with a as (select l_orderkey as allele, l_partkey as gene, l_linenumber as ln, l_returnflag as symbol, row_number() over (partition by l_orderkey, l_partkey order by l_linenumber, l_suppkey, l_returnflag) as rn from lineitem),
j as (select allele, gene, symbol, p_brand, p_name, p_size, p_type from a left join part on p_partkey = gene and p_partkey % 3 <> 0 where rn = 1),
raw as (select allele, gene, unnest([allele::varchar, 'ClinVar AlleleID ' || allele, gene::varchar, symbol, 'HGNC:' || (case when p_brand is null then null else gene end), p_brand, p_name, p_brand, 'S' || p_size, p_type, p_name, '-', 'na']) as text,
  unnest(['clinvar_allele_id', 'clinvar_allele_text', 'entrez_gene_id', 'gene_symbol', 'hgnc_id', 'hgnc_symbol', 'hgnc_name', 'hgnc_alias_symbol', 'hgnc_alias_symbol', 'hgnc_alias_symbol', 'hgnc_prev_symbol', 'refseq_accession', 'uniprot_id']) as notation, unnest(range(1, 14)) as pos, p_brand is not null as known from j),
f as (select *, row_number() over (partition by allele, gene, text order by pos) as rn from raw where coalesce(text, '') <> '' and (known or pos <= 4))
select 'clinvar_gene:' || allele || ':' || gene as fact_id, notation, text, row_number() over (partition by allele, gene order by pos) - 1 as pos from f where rn = 1
""")
def allele_gene_classes(spark, d):
    li = table(spark, d, "lineitem")
    rows = li.select(
        F.struct(F.col("l_orderkey").alias("file"), F.struct("l_linenumber", "l_suppkey", "l_returnflag").alias("row")).alias("ord"), F.col("l_orderkey").cast("string").alias("AlleleID"), F.col("l_partkey").cast("string").alias("GeneID"),
        F.col("l_returnflag").alias("Symbol"), F.lit("").alias("Name"), F.lit("1").alias("GenesPerAlleleID"), F.lit("c").alias("Category"), F.lit("s").alias("Source"),
    )
    genes = files.by_entrez(_genes(spark, d).filter(F.col("entrez_id").cast("int") % 3 != 0))
    return C.flatten(C.allele_classes(rows, genes)).select("fact_id", "notation", "text", F.col("pos").cast("bigint").alias("pos"))


@query("""
with r as (select l_orderkey as v, l_linenumber as ln, l_partkey as p, l_suppkey as s, l_returnflag as sym,
  'NM_' || l_suppkey || '.1:c.' || l_partkey || 'A>G' as ne, case when l_linenumber % 2 = 0 then 'NC_1.1:g.' || l_suppkey || 'del' else '-' end as nc, 'NP_1.1:p.Val' || l_suppkey || 'Glu' as pe from lineitem)
select 'clinvar_hgvs:' || v as fact_id, arg::varchar as gene_id, min(s)::varchar as protein_position, least(min(p), min(case when ln % 2 = 0 then s end))::varchar as nucleotide_position, min(p)::varchar as cdna_position,
  (min(case when ln % 2 = 0 then s end))::varchar as genomic_position, string_agg(distinct s::varchar, '|' order by s::varchar) as allele_ids,
  1 + 1 + 2 * count(distinct s) + 2 - (case when count(*) filter (where arg = s) > 0 then 1 else 0 end) - (case when v = any(list(s)) then 1 else 0 end) - (case when v = arg then 1 else 0 end) + (case when v = arg and count(*) filter (where arg = s) > 0 then 1 else 0 end) + count(distinct ne) + count(distinct case when nc <> '-' then nc end) + count(distinct pe) as n_forms
from (select *, first_value(p) over (partition by v order by ln, p) as arg from r) group by v, arg
""")
def hgvs_variant_classes(spark, d):
    li = table(spark, d, "lineitem")
    s = lambda c: F.col(c).cast("string")
    rows = li.select(
        F.struct(F.col("l_orderkey").alias("file"), F.struct("l_linenumber", "l_partkey").alias("row")).alias("ord"), F.col("l_returnflag").alias("Symbol"), s("l_partkey").alias("GeneID"), s("l_orderkey").alias("VariationID"), s("l_suppkey").alias("AlleleID"),
        F.lit("coding").alias("Type"), F.lit("na").alias("Assembly"), F.concat(F.lit("NM_"), s("l_suppkey"), F.lit(".1:c."), s("l_partkey"), F.lit("A>G")).alias("NucleotideExpression"),
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("NC_1.1:g."), s("l_suppkey"), F.lit("del"))).otherwise("-").alias("NucleotideChange"), F.concat(F.lit("NP_1.1:p.Val"), s("l_suppkey"), F.lit("Glu")).alias("ProteinExpression"), F.lit("-").alias("ProteinChange"),
    )
    genes = files.by_entrez(_genes(spark, d).filter("false"))
    out = C.hgvs_classes(rows, genes)
    a = lambda k: F.try_element_at("attrs", F.lit(k)).alias(k)
    return out.select("fact_id", a("gene_id"), a("protein_position"), a("nucleotide_position"), a("cdna_position"), a("genomic_position"), F.array_join(F.element_at("attr_lists", "allele_ids"), "|").alias("allele_ids"), F.size("forms").cast("bigint").alias("n_forms"))


@query("""
with r as (select l_orderkey as v, l_linenumber as ln, l_returnflag as sig, l_linestatus as rev, l_suppkey as s, l_partkey as p from lineitem),
t as (
  select v, 'GRCh38:7:' || s || '-' || s as text, 'genomic_coordinate' as notation from r where ln % 2 = 1
  union select v, 'GRCh38:7:' || s || '-' || p, 'genomic_coordinate' from r where ln % 2 = 0
  union select v, '7:' || p || ':A>T', 'vcf_allele' from r
  union select v, 'RCV' || p, 'rcv_accession' from r
  union select v, 'p' || s, 'phenotype' from r)
select 'clinvar_summary:' || v as fact_id, notation, text from t
""")
def variant_summary_classes(spark, d):
    rows = _summary_rows(spark, d)
    kinds = ("genomic_coordinate", "vcf_allele", "rcv_accession", "phenotype")
    return C.flatten(C.summary_classes(rows)).filter(F.col("notation").isin(*kinds)).select("fact_id", "notation", "text")


def _summary_rows(spark, d):
    """A variant summary made of lines of orders."""
    li = table(spark, d, "lineitem")
    s = lambda c: F.col(c).cast("string")
    odd = F.col("l_linenumber") % 2 == 1
    named = {
        "VariationID": s("l_orderkey"), "AlleleID": F.lit("-"), "GeneID": F.lit("na"), "GeneSymbol": F.lit(""), "HGNC_ID": F.lit(None).cast("string"), "Assembly": F.lit("GRCh38"), "Chromosome": F.lit("7"),
        "Start": s("l_suppkey"), "Stop": F.when(odd, "").otherwise(s("l_partkey")), "ReferenceAlleleVCF": F.lit("A"), "AlternateAlleleVCF": F.lit("T"), "PositionVCF": s("l_partkey"), "Type": F.lit("snv"),
        "ClinicalSignificance": F.col("l_returnflag"), "ReviewStatus": F.col("l_linestatus"), "Name": F.lit("na"), "RS# (dbSNP)": F.lit("-"), "Cytogenetic": F.lit(""),
        "RCVaccession": F.concat(F.lit("RCV"), s("l_partkey"), F.lit("|na")), "PhenotypeList": F.concat(F.lit("-|p"), s("l_suppkey")), "OtherIDs": F.lit(""),
    }
    return li.select(F.struct(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("row")).alias("ord"), *(c.alias(n) for n, c in named.items()))


@query("""
select n_nationkey, case n_nationkey % 5 when 0 then '' when 1 then '' when 2 then ' ' || n_name when 3 then n_name else n_name end as hgvs,
  case n_nationkey % 5 when 0 then '' when 1 then '' when 2 then ' ' || n_name when 3 then n_name else n_name end as summary,
  case n_nationkey % 5 when 0 then '-' when 1 then '' when 2 then ' ' || n_name when 3 then n_name else n_name end as plain from nation
""")
def clean_values(spark, d):
    n = table(spark, d, "nation")
    k = F.col("n_nationkey") % 5
    raw = F.when(k == 0, " - ").when(k == 1, "").when(k == 2, F.concat(F.lit(' " '), "n_name", F.lit('"'))).when(k == 3, F.concat(F.lit(" "), "n_name", F.lit("\t"))).otherwise(F.col("n_name"))
    return n.select("n_nationkey", T.clean(raw).alias("hgvs"), T.clean_summary(raw).alias("summary"), T.unquote(raw).alias("plain"))


@query("select p_partkey, p_brand || ';' || p_type || ';-;na' as plain, p_brand || ';' || p_type || ';na' as hgvs, p_brand || ';' || p_type as summary, 5 - 1 as n from part")
def split_pipe_values(spark, d):
    raw = F.concat_ws("|", F.col("p_brand"), F.lit(""), F.concat(F.lit(" "), "p_type", F.lit(" ")), F.lit("-"), F.lit("na"))
    j = lambda c: F.array_join(c, ";")
    return table(spark, d, "part").select("p_partkey", j(T.split_values(raw)).alias("plain"), j(T.split_values(raw, "|", ("-",))).alias("hgvs"), j(T.split_values(raw, "|", ("-", "na"))).alias("summary"), F.size(T.split_values(raw)).alias("n"))


@query("""
select p_partkey, p_partkey as protein, (case when p_size % 3 = 0 then -p_size else p_size end)::bigint as nucleotide, null::bigint as bare, regexp_extract(p_type, '([0-9]+)', 1) as none from part
""")
def parsed_positions(spark, d):
    sign = F.when(F.col("p_size") % 3 == 0, "-").when(F.col("p_size") % 3 == 1, "*").otherwise("")
    protein = F.concat(F.lit("NP_1.1:p.Val"), F.col("p_partkey").cast("string"), F.lit("Glu"))
    nucleotide = F.concat(F.lit("NM_1.1:c."), sign, F.col("p_size").cast("string"), F.lit("A>G"))
    return table(spark, d, "part").select("p_partkey", T.position_of(protein, "protein_position").alias("protein"), T.position_of(nucleotide, "cdna_position").alias("nucleotide"), T.protein_position(F.concat(F.lit("p.Val"), F.col("p_size").cast("string"))).alias("bare"), F.regexp_extract("p_type", "([0-9]+)", 1).alias("none"))


@query("""
select event_id, case when event_id % 7 = 0 then null when event_id % 7 = 1 then null when event_id % 7 = 2 then null else json_extract_string(props, '$.k')::double end as k, round(value, 6) as v from events
""")
def numeric_attributes(spark, d):
    m = F.col("event_id") % 7
    raw = F.when(m == 0, "1_0").when(m == 1, "1d").when(m == 2, " ").when(m == 3, F.concat(F.lit(" "), F.get_json_object("props", "$.k"), F.lit(" "))).otherwise(F.get_json_object("props", "$.k"))
    return table(spark, d, "events").select("event_id", T.number(raw).alias("k"), F.round(T.number(F.col("value").cast("string")), 6).alias("v"))


@query("select page_id, regexp_replace(url, '[0-9]', '#', 'g') as masked, regexp_replace(url, '[0-9]', '', 'g') as stripped from pages")
def text_transforms(spark, d):
    return table(spark, d, "pages").select("page_id", T.mask_digits(F.col("url")).alias("masked"), T.strip_digits(F.col("url")).alias("stripped"))


@query("""
select p_partkey, array_to_string(list_transform(range(1, 25), lambda i: case when i <= length(p_name) then ascii(substr(p_name, i::int, 1)) + 1 else 0 end), ',') as ids, least(length(p_name), 24)::double as mask_sum from part
""")
def byte_tokens(spark, d):
    ids = T.byte_ids(F.col("p_name"), 24)
    mask = F.aggregate(T.byte_mask(ids), F.lit(0.0), lambda a, x: a + x)
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(ids, lambda i: i.cast("string")), ",").alias("ids"), mask.alias("mask_sum"))


@query("""
with t as (select ' ' || lower(p_name) || ' ' as t from part), g as (select unnest(flatten(list_transform([2, 3, 4, 5], lambda n: list_transform(range(1, length(t) - n + 2), lambda i: substr(t, i::int, n))))) as gram from t)
select gram, count(*) as n from g group by gram
""")
def char_ngram_counts(spark, d):
    return table(spark, d, "part").select(F.explode(T.char_ngrams(F.col("p_name"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query("select p_partkey, printf('%g', round(p_retailprice, 2)) as price, printf('%g', p_size::double) as size, printf('%.3g', p_size / 8.0) as part3 from part")
def number_format(spark, d):
    size = F.col("p_size").cast("double")
    return table(spark, d, "part").select("p_partkey", T.format_g(F.round("p_retailprice", 2)).alias("price"), T.format_g(size).alias("size"), T.format_g(size / 8, 3).alias("part3"))


@query("select l_orderkey, l_linenumber, case when l_quantity < 10 then 'low' when l_quantity > 40 then 'high' else 'normal' end as status from lineitem")
def range_status(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.status(F.col("l_quantity"), F.lit(10.0), F.lit(40.0)).alias("status"))


@query("select doc_id, source from documents where doc_id in (select doc_id from labels where quality = 1)")
def keep_facts(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("fact_id"), "source")
    return S.keep_facts(docs, table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("fact_id"))).select(F.col("fact_id").alias("doc_id"), "source")


@query("select doc_id, source from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id and toxic = 1)")
def exclude_facts(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("fact_id"), "source")
    ref = table(spark, d, "labels").select(F.col("doc_id").alias("fact_id"), F.when(F.col("toxic") == 1, "test").otherwise("train").alias("split"))
    return S.keep_facts(docs, ref, "test", exclude=True).select(F.col("fact_id").alias("doc_id"), "source")


@query(f"with {CONV_SQL} select fact_id, count(*) filter (where notation = 'user') as users, count(*) as n from forms group by fact_id having count(*) filter (where notation = 'system') > 0 and count(*) filter (where notation = 'assistant') > 0")
def required_notations(spark, d):
    c = conversation_classes(spark, d).filter(C.has_notations("forms", ["system", "assistant"]))
    return c.select("fact_id", F.size(C.of_notation("forms", "user")).cast("bigint").alias("users"), F.size("forms").cast("bigint").alias("n"))


@query(f"with {CONV_SQL} select form_id, case when notation = 'assistant' then 'test' else 'train' end as split from forms")
def split_by_notation(spark, d):
    return S.by_notation(C.flatten(conversation_classes(spark, d)), "assistant", "chat").select("form_id", "split")


@query(f"with {CONV_SQL} select form_id, case when conv_id % 2 = 1 then 'test' else 'train' end as split from forms")
def split_by_attribute(spark, d):
    return S.by_attribute(C.flatten(conversation_classes(spark, d)), "parity", "1").select("form_id", "split")


@query(f"with {PART_SQL} select form_id, case when p_size between 10 and 20 then 'test' else 'train' end as split from forms")
def split_by_range(spark, d):
    return S.by_range(C.flatten(part_classes(spark, d)), "size", 10, 20).select("form_id", "split")


@query("""
with f as (select o_orderkey::varchar as fact_id, row_number() over (order by md5(o_orderkey::varchar || '|13'), o_orderkey::varchar) as place, count(*) over () as n from orders)
select fact_id, case when place <= greatest(1, least(floor(n * 0.2), n - 1)) then 'test' else 'train' end as split from f
""")
def split_by_fact(spark, d):
    forms = F.array(F.struct(F.col("o_orderpriority").alias("text"), F.lit("priority").alias("notation")))
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("fact_id"), F.lit("order").alias("track"), forms.alias("forms"))
    return S.by_fact(o, 0.2, required=["priority"]).select("fact_id", "split")


@query("""
with f as (select doc_id, row_number() over (order by md5(doc_id::varchar || '|13'), doc_id) as place, count(*) over () as n from documents)
select doc_id, case when place <= greatest(1, floor(n * 0.1)) then 'valid' else 'train' end as split from f
""")
def split_rows(spark, d):
    return S.by_row(table(spark, d, "documents").select("doc_id"), "doc_id", 0.1).select("doc_id", "split")


@query(f"with {CONV_SQL} select case when notation = 'assistant' then 'test' else 'train' end as split, count(*) as n from forms group by 1")
def split_counts(spark, d):
    return S.counts(S.by_notation(C.flatten(conversation_classes(spark, d)), "assistant"))


@query(f"""
with {CONV_SQL}
select 'shared_facts' as finding, count(distinct a.fact_id) as n from forms a join forms b using (fact_id) where a.notation <> 'assistant' and b.notation = 'assistant'
union all select 'heldout_in_train', count(*) from forms where notation = 'assistant' and notation <> 'assistant'
union all select 'heldout_missing_in_test', case when count(*) = 0 then 1 else 0 end from forms where notation = 'assistant'
""")
def leakage_audit(spark, d):
    forms = S.by_notation(C.flatten(conversation_classes(spark, d)), "assistant")
    return S.audit(forms.filter("split = 'train'"), forms, "test", "assistant")


@query("""
select 'region' as key, 'new' as state, 5 as rows union all select 'part', 'old', 1 union all select 'nation', 'new', 25
""")
def manifest_upsert(spark, d):
    old = spark.createDataFrame([("region", "old", 1), ("part", "old", 1)], "key string, state string, rows int")
    new = table(spark, d, "region").agg(F.lit("region").alias("key"), F.lit("new").alias("state"), F.count("*").cast("int").alias("rows"))
    new = new.unionByName(table(spark, d, "nation").agg(F.lit("nation").alias("key"), F.lit("new").alias("state"), F.count("*").cast("int").alias("rows")))
    return files.upsert(old, new)


@query("select * from (values ('clinical_labs', 4, 4, 4), ('gene_alias', 2, 0, 0), ('variant', 3, 3, 0)) as t(track, n, compressed, credentialed)")
def source_registry(spark, d):
    i = lambda c: F.count_if(c).cast("int").alias(c)
    return registry.selected(spark, ["all"]).groupBy("track").agg(F.count("*").cast("int").alias("n"), i("compressed"), i("credentialed"))


@query("select 'segment' as field, c_mktsegment as value, (dense_rank() over (order by c_mktsegment) - 1)::int as index from (select distinct c_mktsegment from customer)")
def attribute_vocabulary(spark, d):
    rows = table(spark, d, "customer").select(attrs(segment=F.col("c_mktsegment"), none=F.lit(" ")).alias("attrs"))
    return X.vocabularies(rows, ["segment", "none"])


_STATS = """
s as (select 'quantity' as field, min(l_quantity) + 0.0 as low, max(l_quantity) as high, greatest(max(l_quantity) - min(l_quantity), 1.0) as scale from lineitem
  union all select 'discount', min(l_discount) + 0.0, max(l_discount), greatest(max(l_discount) - min(l_discount), 1.0) from lineitem)
"""


@query(f"with {_STATS} select * from s")
def numeric_field_stats(spark, d):
    rows = table(spark, d, "lineitem").select(attrs(quantity=F.col("l_quantity"), discount=F.col("l_discount"), none=F.lit("x")).alias("attrs"))
    return X.numeric_stats(rows, ["quantity", "discount", "none"])


@query(f"""
with {_STATS}, q as (select low, scale from s where field = 'quantity')
select l_orderkey, l_linenumber, round((l_quantity - low) / scale, 9) as value, 1.0::double as present, 0.0::double as absent, round(sin((l_quantity - low) / scale * 4 * pi()), 9) + 0.0 as sin2, round(cos((l_quantity - low) / scale * 4 * pi()), 9) + 0.0 as cos2 from lineitem, q
""")
def numeric_encoding(spark, d):
    rows = spread(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")).select("l_orderkey", "l_linenumber", attrs(quantity=F.col("l_quantity"), none=F.lit("x")).alias("attrs"))
    out = X.encode_numeric(rows, X.numeric_stats(rows, ["quantity"]), ["quantity", "none"])
    f, e = X.fourier_features(F.col("numeric"), 4), X.explicit_features(F.col("numeric"))
    return out.select("l_orderkey", "l_linenumber", F.round(e[0], 9).alias("value"), e[2].alias("present"), e[3].alias("absent"), (F.round(f[2], 9) + 0.0).alias("sin2"), (F.round(f[10], 9) + 0.0).alias("cos2"))


@query(f"""
with {CONV_SQL}, k as (select *, count(*) over (partition by fact_id) as n, row_number() over (partition by fact_id order by md5(form_id || '|13'), form_id) as take from forms)
select fact_id, form_id, take from k where n >= 2 and take <= 3
""")
def class_form_sample(spark, d):
    return X.class_forms(C.flatten(conversation_classes(spark, d)), 3).select("fact_id", "form_id", F.col("take").cast("bigint").alias("take"))



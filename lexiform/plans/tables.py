"""Queries that write files of the sources' formats and read them back, and generated classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiform.operators import classes as C
from lexiform.plans import base
from lexiform.plans import forms as P
from lexiform.plans.base import CONV_SQL, conversation_classes, query, table
from lexiform.sources import files, registry, synthetic
from lexiform.sources.shared import new_path


#: Rows of a written file, about: a task sorts and packs them, and a packed file is read by one task.
FILE_ROWS = 250_000


def _n_files(df) -> int:
    return max(4, -(-df.count() // FILE_ROWS))


def _written(df, name: str, order: list[str], packed: bool = True, mark: str = "") -> str:
    """A folder of tab-separated files with a header; rows that belong together stand in one file, in order."""
    path, first = new_path(df.sparkSession, name), [c for c in df.columns if c != "ord"][0]
    rows = df.repartition(_n_files(df), first if order == [] else F.col(order[0])).sortWithinPartitions(*order) if order else df
    rows = rows.drop("ord").withColumnRenamed(first, mark + first) if mark else rows.drop("ord")
    rows.write.option("sep", "\t").option("header", True).option("escape", '"').option("compression", "gzip" if packed else "none").csv(path)
    return path


@query(base.SQL["gene_alias_classes"])
def gene_file_classes(spark, d):
    """gene_alias_classes through a file: quoted lists, repeated texts, null markers that stay."""
    path = _written(P._genes(spark, d), "genes", [], packed=False)
    return C.flatten(C.hgnc_classes(files.read_hgnc(spark, path))).select("fact_id", "notation", "text", F.col("pos").cast("bigint").alias("pos"))


@query(base.SQL["allele_gene_classes"])
def allele_file_classes(spark, d):
    """allele_gene_classes through packed files, with rows of several genes that have to go."""
    li = table(spark, d, "lineitem")
    rows = li.select(
        F.col("l_orderkey").cast("string").alias("AlleleID"), F.col("l_partkey").cast("string").alias("GeneID"), F.col("l_returnflag").alias("Symbol"), F.lit("").alias("Name"),
        F.explode(F.array(F.lit("1"), F.lit("2"))).alias("GenesPerAlleleID"), F.lit("c").alias("Category"), F.lit("s").alias("Source"), "l_linenumber", "l_suppkey",
    )
    rows = files.read_allele_gene(spark, _written(rows, "alleles", ["AlleleID", "l_linenumber", "l_suppkey", "Symbol"], mark="#"))
    genes = files.by_entrez(files.read_hgnc(spark, _written(P._genes(spark, d).filter(F.col("entrez_id").cast("int") % 3 != 0), "genes", [], packed=False)))
    return C.flatten(C.allele_classes(rows, genes)).select("fact_id", "notation", "text", F.col("pos").cast("bigint").alias("pos"))


_HGVS_FILE = """
with r as (select l_orderkey as v, l_linenumber as ln, l_partkey as p from lineitem),
g as (select v, arg_min(p, ln::bigint * 1000000000 + p) as gene from r group by v)
select 'clinvar_hgvs:' || v as fact_id, gene::varchar as gene_id, case when gene % 3 <> 0 then 'HGNC:' || gene end as hgnc_id, case when gene % 3 <> 0 then p_name end as hgnc_name from g join part on p_partkey = gene
"""


@query(_HGVS_FILE)
def variant_file_classes(spark, d):
    """Classes from packed lines without quotes, beside comments and lines of another arity; two thirds of the genes are known."""
    li, s = table(spark, d, "lineitem"), lambda c: F.col(c).cast("string")
    fields = [
        F.col("l_returnflag"), s("l_partkey"), s("l_orderkey"), s("l_suppkey"), F.lit("coding"), F.lit("na"), F.concat(F.lit("NM_"), s("l_suppkey"), F.lit(".1:c."), s("l_partkey"), F.lit("A>G")),
        F.lit("-"), F.concat(F.lit("NP_1.1:p.Val"), s("l_suppkey"), F.lit('Glu"')), F.lit("-"), F.lit("Yes"), F.lit("No"), F.lit(""),
    ]
    lines = li.repartition(_n_files(li), "l_orderkey").sortWithinPartitions("l_orderkey", "l_linenumber", "l_partkey").select(F.concat_ws("\t", *fields).alias("value"))
    path = new_path(spark, "hgvs")
    lines.write.option("compression", "gzip").text(path)
    spark.createDataFrame([("#Symbol\tGeneID",), ("A\t1\t999999999\t4",)], "value string").write.mode("append").option("compression", "gzip").text(path)
    genes = files.by_entrez(P._genes(spark, d).filter(F.col("entrez_id").cast("int") % 3 != 0))
    out = C.hgvs_classes(files.read_hgvs(spark, path), genes)
    a = lambda k: F.nullif(F.try_element_at("attrs", F.lit(k)), F.lit("")).alias(k)
    return out.select("fact_id", a("gene_id"), a("hgnc_id"), a("hgnc_name"))


@query("""
with r as (select l_orderkey as v, l_linenumber as ln, l_partkey as p, row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey) as n from lineitem),
g as (select v, arg_min(p, n) as gene, min(n) as first from r group by v order by first limit 200) select 'clinvar_hgvs:' || v as fact_id, gene::varchar as gene_id from g
""")
def first_file_classes(spark, d):
    """The first 200 classes of a packed file in its order; the scan stops when they are there."""
    li, s = table(spark, d, "lineitem"), lambda c: F.col(c).cast("string")
    fields = [F.lit("A"), s("l_partkey"), s("l_orderkey"), s("l_suppkey"), F.lit("coding"), F.lit("na"), F.concat(F.lit("NM_"), s("l_suppkey"), F.lit(".1:c."), s("l_partkey"), F.lit("A>G")), F.lit("-"), F.lit("-"), F.lit("-"), F.lit(""), F.lit(""), F.lit("")]
    path = new_path(spark, "hgvs")
    # Files are named by the range that they hold.
    lines = li.repartitionByRange(_n_files(li), "l_orderkey").sortWithinPartitions("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").select(F.concat_ws("\t", *fields).alias("value"))
    lines.write.option("compression", "gzip").text(path)
    out = C.first_hgvs_classes(spark, path, files.by_entrez(P._genes(spark, d)), 200, split_bytes=1 << 16)
    return out.select("fact_id", F.try_element_at("attrs", F.lit("gene_id")).alias("gene_id"))


@query(base.SQL["variant_summary_classes"])
def summary_file_classes(spark, d):
    """variant_summary_classes through packed files."""
    rows = P._summary_rows(spark, d)
    rows = files.read_variant_summary(spark, _written(rows.withColumn("line", F.col("ord.row")), "summaries", ["VariationID", "line"], mark="#"))
    kinds = ("genomic_coordinate", "vcf_allele", "rcv_accession", "phenotype")
    return C.flatten(C.summary_classes(rows)).filter(F.col("notation").isin(*kinds)).select("fact_id", "notation", "text")


@query(f"with {CONV_SQL} select form_id, fact_id, notation, md5(text) as text_md5 from forms")
def jsonl_classes(spark, d):
    """Classes written as JSON lines, read back, checked and flattened; flattening forms changes nothing."""
    path = new_path(spark, "classes")
    files.write_jsonl(conversation_classes(spark, d), path)
    forms = C.as_forms(C.validate(files.read_jsonl(spark, path)))
    return C.as_forms(forms).select("form_id", "fact_id", "notation", F.md5("text").alias("text_md5"))


@query(r"""
select '{"attrs":{"a":"' || n_name || '","b":"caf\u00e9 \ud83d\ude00"},"forms":[{"notation":"n","text":"\u6f22' || n_nationkey || '"}],"id":' || n_nationkey || ',"none":null}' as line from nation
""".replace("\\\\", "\\"))
def jsonl_lines(spark, d):
    """The lines as written: keys in order at every depth, ASCII, nulls stated."""
    n = table(spark, d, "nation")
    rows = n.select(
        F.lit(None).cast("string").alias("none"), F.col("n_nationkey").alias("id"), F.array(F.struct(F.concat(F.lit("\u6f22"), F.col("n_nationkey").cast("string")).alias("text"), F.lit("n").alias("notation"))).alias("forms"),
        F.create_map(F.lit("b"), F.lit("caf\u00e9 \U0001f600"), F.lit("a"), F.col("n_name")).alias("attrs"),
    )
    path = new_path(spark, "lines")
    files.write_jsonl(rows, path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("select 'gene:HGNC:' || p_partkey || ':' || p_brand as fact_id from part order by p_partkey limit 50")
def capped_classes(spark, d):
    return C.validate(C.hgnc_classes(P._genes(spark, d), limit=50)).select("fact_id")


@query("select * from (values ('clinvar_hgvs', 'hgvs4variation.txt.gz'), ('hgnc_withdrawn', 'hgnc_withdrawn.txt')) as t(key, filename)")
def rendered_sources(spark, d):
    out = registry.rendered(spark, ["hgnc_withdrawn", "clinvar_hgvs"])
    return out.select("key", F.get_json_object("line", "$.filename").alias("filename"))


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_AMINO, _GENES, _BASES = synthetic.AMINO_ACIDS, synthetic.GENES, synthetic.BASES
_DRAWS = ", ".join(f"(('0x' || substr(md5(id || '|13|{what}'), 1, 8))::bigint % {n})::int as {name}" for what, n, name in (("gene", 8, "g"), ("ref", 20, "r"), ("alt", 19, "a0"), ("pos", 1196, "p0"), ("phase", 3, "phase"), ("base", 4, "b")))


@query(f"""
with d as (select {_DRAWS} from range(200) t(id)), e as (select *, a0 + (a0 >= r)::int as a, p0 + 5 as pos from d),
v as (select pos, pos * 3 - phase as cdna, ({_list(g[0] for g in _GENES)})[g + 1] as gene, ({_list(g[1] for g in _GENES)})[g + 1] as tr, ({_list(x[0] for x in _BASES)})[b + 1] as b0, ({_list(x[1] for x in _BASES)})[b + 1] as b1,
  {", ".join(f"({_list(x[k] for x in _AMINO)})[{s} + 1] as {s}{k + 1}" for s in "ra" for k in range(3))} from e),
f as (select 'variant:' || gene || ':p.' || r2 || pos || a2 as fact_id, unnest([gene || ' ' || r1 || pos || a1, gene || ' p.' || r2 || pos || a2, gene || ' ' || r2 || pos || a2, tr || ':c.' || cdna || b0 || '>' || b1,
  'missense variant in ' || gene || ' changing ' || r3 || ' to ' || a3 || ' at protein position ' || pos]) as text,
  unnest(['protein_one_letter', 'protein_three_letter', 'protein_three_letter_short', 'cdna_hgvs_like', 'text_description']) as notation, unnest(range(5)) as i from v)
select fact_id || '::' || i as form_id, fact_id, 'variant' as track, notation, text from f
""")
def synthetic_variants(spark, d):
    return C.flatten(synthetic.variants(spark, 200)).select("form_id", "fact_id", "track", "notation", "text")


_LAB_ROWS = ", ".join(f"('{n}', '{u}', '{o}', {f}::double, {lo}::double, {hi}::double, {vals}::double[])" for n, u, o, f, lo, hi, vals in synthetic.LABS)


@query(f"""
with l as (select name, unit, other, factor, low, high, unnest(vals) as v from (values {_LAB_ROWS}) as t(name, unit, other, factor, low, high, vals)),
f as (select 'lab:' || name || ':' || printf('%g', v) || ':' || unit as fact_id, unnest([name || ' ' || printf('%g', v) || ' ' || unit, name || ' ' || printf('%.3g', v * factor) || ' ' || other,
  name || ' reference range ' || printf('%g', low) || '-' || printf('%g', high) || ' ' || unit, name || ' is ' || case when v < low then 'low' when v > high then 'high' else 'normal' end]) as text,
  unnest(['canonical_unit', 'alternate_unit', 'reference_range', 'text_interpretation']) as notation, unnest(range(4)) as i from l)
select fact_id || '::' || i as form_id, fact_id, 'lab' as track, notation, text from f
""")
def synthetic_labs(spark, d):
    return C.flatten(synthetic.labs(spark)).select("form_id", "fact_id", "track", "notation", "text")

"""Equivalence classes: a fact with its surface forms in order, and attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiform.functions.text import clean, clean_summary, let, nucleotide_position, protein_position, split_values, strip, unquote
from lexiform.sources import files, members
from lexiform.sources.shared import discard, materialize

NO_LISTS, FORMS = "map<string,array<string>>", "array<struct<text:string,notation:string>>"


def flatten(classes: DataFrame) -> DataFrame:
    """One row for each form: form_id = fact_id::position, and the columns of its class."""
    rest = [c for c in classes.columns if c not in ("fact_id", "forms")]
    rows = classes.select("fact_id", *rest, F.posexplode("forms").alias("pos", "form"))
    return rows.select(F.concat(F.col("fact_id"), F.lit("::"), F.col("pos").cast("string")).alias("form_id"), "fact_id", "pos", F.col("form.notation").alias("notation"), F.col("form.text").alias("text"), *rest)


def as_forms(df: DataFrame) -> DataFrame:
    """Classes flattened; forms as they are."""
    return flatten(df) if "forms" in df.columns else df


def form(text: Column, notation: str) -> Column:
    return F.array(F.struct(text.alias("text"), F.lit(notation).alias("notation")))


def forms(texts: Column, notation: str) -> Column:
    return F.transform(texts, lambda t: F.struct(t.alias("text"), F.lit(notation).alias("notation")))


def with_forms(df: DataFrame, candidates: Column, nulls: tuple[str, ...] = ()) -> DataFrame:
    """df with forms: candidates in order, texts unquoted, empty ones and null markers dropped, of equal texts the first kept.

    Runs inside the row, without a shuffle. Cleaned forms and their texts are bound once: a column of their own would be computed anew for each form.
    The result comes out of explode, behind which Spark moves no filter: one on its size would compute it twice.
    """
    cleaned = F.transform(candidates, lambda f: F.struct(unquote(f["text"]).alias("text"), f["notation"].alias("notation")))
    held = F.filter(cleaned, lambda f: ~f["text"].isin("", *nulls))
    unique = lambda fs: let(F.transform(fs, lambda f: f["text"]), lambda texts: F.filter(fs, lambda f, i: F.array_position(texts, f["text"]) == i + 1))
    return df.drop("forms").select("*", F.explode(F.array(let(held, unique))).alias("forms"))


def first_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order: a partial aggregate, not a sort of each group."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in rest)), F.struct(*order)).alias("row"))
    return first.select(*keys, *(F.col(f"row.`{c}`") for c in rest)).select(*df.columns)


def cap(df: DataFrame, order: list[Column], n: int | None) -> DataFrame:
    """The first n rows in order; all of them for None."""
    return df if n is None else df.orderBy(*order).limit(n)


def runs(df: DataFrame, key: str, order: list[Column], by: list[str]) -> DataFrame:
    """Adds run: in each sequence that ``by`` names, consecutive rows of equal key, in order, share a number."""
    w = Window.partitionBy(*by).orderBy(*order)
    changed = F.when(F.col(key).eqNullSafe(F.lag(key).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_new", changed).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def file_runs(df: DataFrame, key: str) -> DataFrame:
    """runs() over whole files in the order of ``ord``. Each read split is numbered by itself; a row a split carries numbers and last keys over."""
    rows = df.withColumn("_split", F.struct(F.col("ord.file").alias("file"), F.shiftright("ord.row", 33).alias("part")))
    rows = runs(rows, key, [F.col("ord")], ["_split"])
    ends = rows.groupBy("_split").agg(F.min_by(key, "ord").alias("first"), F.max_by(key, "ord").alias("last"), F.max("run").alias("n"))
    w = Window.orderBy("_split")  # a row for each split
    joins = F.col("first").eqNullSafe(F.lag("last").over(w)) & (F.row_number().over(w) > 1)
    ends = ends.withColumn("own", F.col("n") - F.when(joins, 1).otherwise(0))
    ends = ends.select("_split", (F.sum("own").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("_before"))
    return rows.join(F.broadcast(ends), "_split").withColumn("run", F.col("run") + F.col("_before")).drop("_split", "_before")


def has_notations(forms_col: str, required: list[str]) -> Column:
    """Whether every required notation occurs among the forms."""
    held = F.transform(F.col(forms_col), lambda f: f["notation"])
    return F.size(F.array_except(F.array(*map(F.lit, required)).cast("array<string>"), held)) == 0


def of_notation(forms_col: str, notation: str) -> Column:
    return F.filter(F.col(forms_col), lambda f: f["notation"] == notation)


def _attrs(**values: Column) -> Column:
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v.cast("string"))))


def _shaped(df: DataFrame, fact: Column, track: str, least: int, attrs: Column, lists: Column | None = None) -> DataFrame:
    lists = F.create_map().cast(NO_LISTS) if lists is None else lists
    out = df.select("ord", fact.alias("fact_id"), F.lit(track).alias("track"), "forms", attrs.alias("attrs"), lists.alias("attr_lists"))
    return out.filter(F.size("forms") >= least)


#: Pipe-delimited columns, in the order in which their forms follow; they name notations too, as do the builders' texts below.
HGNC_LISTS = ["alias_symbol", "alias_name", "prev_symbol", "prev_name", "refseq_accession", "uniprot_ids"]


def hgnc_classes(hgnc: DataFrame, limit: int | None = None) -> DataFrame:
    """A class for each gene with two forms or more."""
    t = lambda c: strip(F.col(c))
    found = F.concat(
        form(F.col("symbol"), "approved_symbol"), form(F.col("name"), "approved_name"), form(F.col("ensembl_gene_id"), "ensembl_gene_id"), form(F.col("entrez_id"), "entrez_gene_id"),
        *(forms(split_values(F.col(c)), c) for c in HGNC_LISTS), forms(split_values(F.col("mane_select")), "mane_select"),
    )
    attrs = _attrs(**{c: t(c) for c in ("hgnc_id", "symbol", "name", "locus_group", "locus_type", "status", "location", "entrez_id", "ensembl_gene_id")})
    out = _shaped(with_forms(hgnc, found), F.concat(F.lit("gene:"), t("hgnc_id"), F.lit(":"), t("symbol")), "gene_alias", 2, attrs)
    return cap(out, [F.col("ord")], limit).drop("ord")


def _with_hgnc(df: DataFrame, hgnc: DataFrame, gene: str) -> DataFrame:
    """Left join with the gene table, columns prefixed h_. Spark broadcasts it where its measured size allows."""
    held = hgnc.select(*(F.col(c).alias(f"h_{c}") for c in hgnc.columns if c != "ord"))
    return df.join(held, F.col(gene) == F.col("h_entrez_id"), "left")


def allele_classes(alleles: DataFrame, hgnc: DataFrame, single_gene: bool = True, limit: int | None = None) -> DataFrame:
    """A class for each allele and gene, joined to gene names; the first row of a fact that has three forms stays. Rows are told apart before their forms are made."""
    t = lambda c: strip(F.col(c))
    own = ("AlleleID", "GeneID", "Symbol", "Name", "GenesPerAlleleID", "Category", "Source")
    rows = alleles.filter(t("GenesPerAlleleID") == "1") if single_gene else alleles
    rows = rows.select("ord", *(t(c).alias(c) for c in own)).filter("AlleleID <> '' and GeneID <> '' and Symbol <> ''")
    text = F.concat(F.lit("ClinVar AlleleID "), "AlleleID")
    # The lists of a gene are taken apart once, not for each of its alleles.
    lists = F.concat(
        forms(split_values(F.col("alias_symbol")), "hgnc_alias_symbol"), forms(split_values(F.col("prev_symbol")), "hgnc_prev_symbol"),
        forms(split_values(F.col("refseq_accession")), "refseq_accession"), forms(split_values(F.col("uniprot_ids")), "uniprot_id"),
    )
    genes = hgnc.select("entrez_id", "hgnc_id", "symbol", "name", "ensembl_gene_id", lists.alias("lists"))
    found = F.concat(
        form(F.col("AlleleID"), "clinvar_allele_id"), form(text, "clinvar_allele_text"), form(F.col("GeneID"), "entrez_gene_id"),
        form(F.col("Symbol"), "gene_symbol"), form(F.col("Name"), "gene_name"), form(F.col("h_hgnc_id"), "hgnc_id"), form(F.col("h_symbol"), "hgnc_symbol"), form(F.col("h_name"), "hgnc_name"),
        form(F.col("h_ensembl_gene_id"), "ensembl_gene_id"), F.coalesce("h_lists", F.array().cast(FORMS)),
    )
    # Ids without quotes that differ are three forms with the text; only other rows are counted by their forms.
    sure = ~F.col("AlleleID").contains('"') & ~F.col("GeneID").contains('"') & ~F.col("GeneID").isin(F.col("AlleleID"), text)
    counted = with_forms(_with_hgnc(rows.withColumn("sure", sure), genes, "GeneID"), F.when(F.col("sure"), F.array().cast(FORMS)).otherwise(found)).filter(F.col("sure") | (F.size("forms") >= 3))
    fact = F.concat(F.lit("clinvar_gene:"), "AlleleID", F.lit(":"), "GeneID")
    first = first_rows(counted.select("ord", fact.alias("fact"), *own), ["fact"], [F.col("ord")])
    attrs = _attrs(
        allele_id=F.col("AlleleID"), gene_id=F.col("GeneID"), symbol=F.col("Symbol"), name=F.col("Name"), genes_per_allele_id=F.col("GenesPerAlleleID"), category=F.col("Category"), source=F.col("Source"),
        hgnc_id=t("h_hgnc_id"), hgnc_symbol=t("h_symbol"), hgnc_name=t("h_name"), ensembl_gene_id=t("h_ensembl_gene_id"),
    )
    return cap(_shaped(with_forms(_with_hgnc(first, genes, "GeneID"), found), F.col("fact"), "clinvar_gene", 3, attrs), [F.col("ord")], limit).drop("ord")


def _grouped(rows: DataFrame, by_runs: bool) -> tuple[DataFrame, list[str]]:
    """Rows with a variation id; the columns that make a group."""
    rows = rows.filter(F.col("vid") != "")
    return (file_runs(rows, "vid"), ["vid", "run"]) if by_runs else (rows, ["vid"])


def _sorted_set(c: Column) -> Column:
    return F.array_sort(F.collect_set(F.nullif(c, F.lit(""))))


def _in_order(columns: list[str]) -> Column:
    """Rows of the group in file order."""
    return F.array_sort(F.collect_list(F.struct("ord", *columns))).alias("rows")


def hgvs_classes(rows: DataFrame, hgnc: DataFrame, require_gene: bool = True, by_runs: bool = False, limit: int | None = None) -> DataFrame:
    """A class for each variation. ``by_runs`` groups consecutive rows only, so that an id can give several classes."""
    names = ["GeneID", "Symbol", "AlleleID", "Type", "Assembly", "NucleotideExpression", "NucleotideChange", "ProteinExpression", "ProteinChange"]
    rows = rows.select("ord", clean(F.col("VariationID")).alias("vid"), *(clean(F.col(c)).alias(c) for c in names))
    rows, keys = _grouped(rows, by_runs)
    spots = [nucleotide_position(F.col(c)) for c in ("NucleotideExpression", "NucleotideChange")]
    least = lambda mark: F.min(F.least(*(F.when(F.col(c).contains(mark), s) for c, s in zip(("NucleotideExpression", "NucleotideChange"), spots, strict=True))))
    group = rows.groupBy(*keys).agg(
        F.min("ord").alias("ord"), F.min_by("GeneID", "ord").alias("gene"), F.min_by("Symbol", "ord").alias("symbol"), _sorted_set(F.col("AlleleID")).alias("alleles"), _sorted_set(F.col("Type")).alias("types"),
        _sorted_set(F.when(F.col("Assembly") != "na", F.col("Assembly"))).alias("assemblies"), F.min(F.coalesce(protein_position(F.col("ProteinExpression")), protein_position(F.col("ProteinChange")))).alias("protein_position"),
        F.min(F.least(*spots)).alias("nucleotide_position"), least(":c.").alias("cdna_position"), least(":g.").alias("genomic_position"), _in_order(names[5:]),
    )
    if require_gene:
        group = group.filter("gene <> '' and symbol <> ''")
    group = _with_hgnc(group, hgnc, "gene")
    kinds = [("NucleotideExpression", "nucleotide_expression"), ("NucleotideChange", "nucleotide_change"), ("ProteinExpression", "protein_expression"), ("ProteinChange", "protein_change")]
    pairs = lambda text, notation: F.struct(text.alias("text"), F.lit(notation).alias("notation"))
    found = F.concat(
        form(F.col("vid"), "clinvar_variation_id"), form(F.concat(F.lit("ClinVar VariationID "), "vid"), "clinvar_variation_text"),
        F.flatten(F.transform("alleles", lambda a: F.array(pairs(a, "clinvar_allele_id"), pairs(F.concat(F.lit("ClinVar AlleleID "), a), "clinvar_allele_text")))),
        form(F.col("gene"), "entrez_gene_id"), form(F.col("symbol"), "gene_symbol"), form(F.col("h_hgnc_id"), "hgnc_id"), form(F.col("h_name"), "hgnc_name"), form(F.col("h_ensembl_gene_id"), "ensembl_gene_id"),
        forms(split_values(clean(F.col("h_alias_symbol"))), "hgnc_alias_symbol"), forms(split_values(clean(F.col("h_uniprot_ids"))), "uniprot_id"),
        F.flatten(F.transform("rows", lambda r: F.array(*(pairs(r[c], k) for c, k in kinds)))),
    )
    attrs = _attrs(
        variation_id=F.col("vid"), gene_id=F.col("gene"), symbol=F.col("symbol"), hgnc_id=strip(F.col("h_hgnc_id")), hgnc_name=strip(F.col("h_name")), ensembl_gene_id=strip(F.col("h_ensembl_gene_id")),
        protein_position=F.col("protein_position"), nucleotide_position=F.col("nucleotide_position"), cdna_position=F.col("cdna_position"), genomic_position=F.col("genomic_position"),
    )
    lists = F.create_map(F.lit("allele_ids"), F.col("alleles"), F.lit("hgvs_types"), F.col("types"), F.lit("assemblies"), F.col("assemblies"))
    out = _shaped(with_forms(group, found, ("-",)), F.concat(F.lit("clinvar_hgvs:"), "vid"), "clinvar_hgvs", 4, attrs, lists)
    return cap(out, [F.col("ord")], limit).drop("ord")


def first_hgvs_classes(spark: SparkSession, path: str, hgnc: DataFrame, limit: int, require_gene: bool = True, split_bytes: int | None = None, splits_read: list[int] | None = None) -> DataFrame:
    """The first ``limit`` classes of a file of variations in order, by runs, from a growing scan.

    One split is read first, then twice as many while classes are short. The last run of what has been read may go on behind
    the edge: it counts only when the file is read to its end. ``splits_read`` gets the number of splits of each scan.
    """
    total, k = max(1, members.split_count(path, split_bytes)), 1
    while True:
        rows = files.read_hgvs(spark, path, split_bytes, k)
        if splits_read is not None:
            splits_read.append(min(k, total))
        if k < total:
            # Rows behind the last change of the variation are left for a longer scan.
            tail = rows.agg(F.max_by(clean(F.col("VariationID")), "ord").alias("vid")).first()["vid"]
            edge = rows.filter(~clean(F.col("VariationID")).eqNullSafe(F.lit(tail))).agg(F.max("ord").alias("edge"))
            rows = rows.join(F.broadcast(edge), F.col("ord") <= F.col("edge")).drop("edge")  # one row
        out = materialize(hgvs_classes(rows, hgnc, require_gene, by_runs=True, limit=limit), "first-classes")
        if k >= total or out.count() >= limit:
            return out
        discard(out)
        k *= 2


def summary_classes(rows: DataFrame, by_runs: bool = False, limit: int | None = None) -> DataFrame:
    """A class for each variation of a variant summary, with coordinates of its assemblies."""
    one = {"AlleleID": "allele", "GeneID": "gene", "GeneSymbol": "symbol", "HGNC_ID": "hgnc", "Assembly": "assembly", "Chromosome": "chr", "Start": "start", "Stop": "stop", "ReferenceAlleleVCF": "ref", "AlternateAlleleVCF": "alt", "PositionVCF": "pos", "Type": "type", "ClinicalSignificance": "significance", "ReviewStatus": "review", "Name": "name", "RS# (dbSNP)": "rs", "Cytogenetic": "band"}
    many = {"RCVaccession": "rcv", "PhenotypeList": "phenotypes", "OtherIDs": "others"}
    rows = rows.select("ord", clean_summary(F.col("VariationID")).alias("vid"), *(clean_summary(F.col(f"`{c}`")).alias(a) for c, a in one.items()), *(split_values(F.col(c), "|", ("-", "na")).alias(a) for c, a in many.items()))
    place = F.when((F.col("chr") != "") & (F.col("start") != ""), F.concat("assembly", F.lit(":"), "chr", F.lit(":"), "start", F.lit("-"), F.when(F.col("stop") != "", F.col("stop")).otherwise(F.col("start"))))
    allele = F.when((F.col("ref") != "") & (F.col("alt") != ""), F.concat("chr", F.lit(":"), "pos", F.lit(":"), "ref", F.lit(">"), "alt"))
    rows, keys = _grouped(rows.withColumn("place", F.coalesce(place, F.lit(""))).withColumn("vcf", F.coalesce(allele, F.lit(""))), by_runs)
    shown = ["name", "rs", "band", "significance", "review", "rcv", "phenotypes", "others", "place", "vcf"]
    group = rows.groupBy(*keys).agg(
        F.min("ord").alias("ord"), *(F.min_by(c, "ord").alias(c) for c in ("allele", "gene", "symbol", "hgnc")), _sorted_set(F.col("type")).alias("types"), _sorted_set(F.col("assembly")).alias("assemblies"),
        _sorted_set(F.col("significance")).alias("significances"), _sorted_set(F.col("review")).alias("reviews"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("phenotypes")))).alias("all_phenotypes"), _in_order(shown),
    )
    pair = lambda text, notation: F.struct(text.alias("text"), F.lit(notation).alias("notation"))
    first = [("name", "clinvar_name"), ("rs", "dbsnp_rs"), ("band", "cytogenetic"), ("significance", "clinical_significance"), ("review", "review_status")]
    found = F.concat(
        form(F.col("vid"), "clinvar_variation_id"), form(F.concat(F.lit("ClinVar VariationID "), "vid"), "clinvar_variation_text"), form(F.col("allele"), "clinvar_allele_id"), form(F.col("gene"), "entrez_gene_id"), form(F.col("symbol"), "gene_symbol"), form(F.col("hgnc"), "hgnc_id"),
        F.flatten(F.transform("rows", lambda r: F.concat(F.array(*(pair(r[c], k) for c, k in first)), forms(r["rcv"], "rcv_accession"), forms(r["phenotypes"], "phenotype"), forms(r["others"], "other_id"), F.array(pair(r["place"], "genomic_coordinate"), pair(r["vcf"], "vcf_allele"))))),
    )
    attrs = _attrs(variation_id=F.col("vid"), allele_id=F.col("allele"), gene_id=F.col("gene"), gene_symbol=F.col("symbol"), hgnc_id=F.col("hgnc"))
    lists = F.create_map(F.lit("variant_types"), F.col("types"), F.lit("assemblies"), F.col("assemblies"), F.lit("clinical_significance"), F.col("significances"), F.lit("phenotypes"), F.col("all_phenotypes"), F.lit("review_status"), F.col("reviews"))
    out = _shaped(with_forms(group, found, ("-", "na")), F.concat(F.lit("clinvar_summary:"), "vid"), "clinvar_summary", 4, attrs, lists)
    return cap(out, [F.col("ord")], limit).drop("ord")


def validate(classes: DataFrame) -> DataFrame:
    """classes, if it has forms and at least one row; else an error."""
    if "forms" not in classes.columns:
        raise ValueError("classes need a column of forms")
    if classes.isEmpty():
        raise ValueError("there are no classes")
    return classes

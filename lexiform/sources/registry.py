"""The public sources that can feed the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, url string, filename string, description string, track string, compressed boolean, credentialed boolean"
#: Names, addresses and tracks as their publishers and users state them.
SOURCES = [
    ("clinvar_variant_summary", "https://ftp.ncbi.nlm.nih.gov/pub/clinvar/tab_delimited/variant_summary.txt.gz", "variant_summary.txt.gz", "one row a variant and assembly, with significance and phenotypes", "variant", True, False),
    ("clinvar_hgvs", "https://ftp.ncbi.nlm.nih.gov/pub/clinvar/tab_delimited/hgvs4variation.txt.gz", "hgvs4variation.txt.gz", "all HGVS expressions of each variation", "variant", True, False),
    ("clinvar_allele_gene", "https://ftp.ncbi.nlm.nih.gov/pub/clinvar/tab_delimited/allele_gene.txt.gz", "allele_gene.txt.gz", "alleles and the genes that they touch", "variant", True, False),
    ("hgnc_complete_set", "https://storage.googleapis.com/public-download-files/hgnc/tsv/tsv/hgnc_complete_set.txt", "hgnc_complete_set.txt", "approved gene names with aliases and accessions", "gene_alias", False, False),
    ("hgnc_withdrawn", "https://storage.googleapis.com/public-download-files/hgnc/tsv/tsv/withdrawn.txt", "hgnc_withdrawn.txt", "withdrawn and merged gene symbols", "gene_alias", False, False),
    ("mimiciv_hosp_d_labitems", "https://physionet.org/files/mimiciv/3.1/hosp/d_labitems.csv.gz", "d_labitems.csv.gz", "dictionary of laboratory items", "clinical_labs", True, True),
    ("mimiciv_hosp_labevents", "https://physionet.org/files/mimiciv/3.1/hosp/labevents.csv.gz", "labevents.csv.gz", "laboratory measurements", "clinical_labs", True, True),
    ("mimiciv_hosp_patients", "https://physionet.org/files/mimiciv/3.1/hosp/patients.csv.gz", "patients.csv.gz", "patients", "clinical_labs", True, True),
    ("mimiciv_hosp_admissions", "https://physionet.org/files/mimiciv/3.1/hosp/admissions.csv.gz", "admissions.csv.gz", "hospital admissions", "clinical_labs", True, True),
]


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOURCES, SCHEMA)


def selected(spark: SparkSession, keys: list[str]) -> DataFrame:
    """The named sources (``all``: every one); an unknown name is an error."""
    known = {s[0] for s in SOURCES}
    if "all" in keys:
        return registry(spark)
    if unknown := sorted(set(keys) - known):
        raise ValueError(f"unknown sources: {', '.join(unknown)}")
    return registry(spark).filter(F.col("key").isin(*keys))


def rendered(spark: SparkSession, keys: list[str]) -> DataFrame:
    """(key, line): each named source as JSON with keys in order."""
    one = selected(spark, keys)
    return one.select("key", json_lines_of(one).alias("line"))


def json_lines_of(df: DataFrame):
    """A row as JSON with keys in order."""
    return F.to_json(F.struct(*(F.col(c) for c in sorted(df.columns))), {"ignoreNullFields": "false"})

"""Scans and sinks. All paths go through Spark's own readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiform.functions.text import ascii_json, sorted_value
from lexiform.sources import members
from lexiform.sources.quoted import read_quoted

FORM = "struct<text:string,notation:string>"
CLASS_SCHEMA = f"fact_id string, track string, forms array<{FORM}>, attrs map<string,string>, attr_lists map<string,array<string>>"
FORM_SCHEMA = "form_id string, fact_id string, track string, notation string, text string, attrs map<string,string>, attr_lists map<string,array<string>>, split string"

#: The columns of hgvs4variation, in file order (fixed by its publisher).
HGVS_COLUMNS = [
    "Symbol", "GeneID", "VariationID", "AlleleID", "Type", "Assembly", "NucleotideExpression",
    "NucleotideChange", "ProteinExpression", "ProteinChange", "UsedForNaming", "Submitted", "OnRefSeqGene",
]


def read_jsonl(spark: SparkSession, path: str, schema: str = CLASS_SCHEMA) -> DataFrame:
    """JSON lines with a stated schema; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def json_lines(df: DataFrame) -> DataFrame:
    """(value): each row as JSON in ASCII, keys in order at every depth, nulls stated."""
    row = F.named_struct(*(x for f in sorted(df.schema.fields, key=lambda f: f.name) for x in (F.lit(f.name), sorted_value(F.col(f"`{f.name}`"), f.dataType))))
    return df.select(ascii_json(F.to_json(row, {"ignoreNullFields": "false"})).alias("value"))


def write_jsonl(df: DataFrame, path: str) -> None:
    json_lines(df).write.mode("overwrite").text(path)


def with_order(df: DataFrame) -> DataFrame:
    """df with ``ord``: file, then position in the file (ids grow within each split of a scan)."""
    return df.withColumn("ord", F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row")))


def read_table(spark: SparkSession, path: str, quoted: bool = True) -> DataFrame:
    """A tab-separated file with a header, all columns text; a ``#`` before the first name goes. Missing trailing fields are null.

    A quoted or packed file cannot be divided, so one task reads it; behind the scan its rows are dealt out, with ``ord`` from before.
    """
    reader = spark.read.option("sep", "\t").option("header", True).option("multiLine", quoted).option("quote", '"' if quoted else "").option("escape", '"')
    df = with_order(reader.csv(path))
    df = df.repartition("ord") if quoted else df
    first = df.columns[0]
    return df.withColumnRenamed(first, first.lstrip("#")) if first.startswith("#") else df


def read_hgnc(spark: SparkSession, path: str) -> DataFrame:
    """The gene table, whose lists are quoted: plain files are read split by split, with line breaks inside quotes."""
    return read_quoted(spark, path)


def read_allele_gene(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path)


def read_variant_summary(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path)


def read_hgvs(spark: SparkSession, path: str, split_bytes: int | None = None, first_splits: int | None = None) -> DataFrame:
    """hgvs4variation: comment lines and rows of another arity than 13 go; there is no quoting. Packed files are read member by member, with filters pushed down."""
    members.register(spark)
    reader = spark.read.format("gene_table").option("path", path).option("columns", ",".join(HGVS_COLUMNS)).option("numbered", "true")
    given = {"splitBytes": split_bytes, "firstSplits": first_splits}
    rows = reader.options(**{k: v for k, v in given.items() if v is not None}).load()
    return rows.select(F.struct("file", "row").alias("ord"), *HGVS_COLUMNS)


def by_entrez(hgnc: DataFrame) -> DataFrame:
    """One row for each entrez_id: the last one in file order; blank ids go."""
    from lexiform.functions.text import strip

    key = strip(F.col("entrez_id"))
    cols = [c for c in hgnc.columns if c not in ("ord", "entrez_id")]
    last = hgnc.withColumn("entrez_id", key).filter("entrez_id <> ''").groupBy("entrez_id").agg(F.max_by(F.struct(*cols), "ord").alias("row"))
    return last.select("entrez_id", "row.*")


def upsert(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """old with the rows of new in place of those with their key."""
    return old.join(new, key, "left_anti").unionByName(new)


def stamped(rows: DataFrame, name: str = "fetched_at") -> DataFrame:
    """rows with the present time in UTC as ISO 8601 text, for a manifest."""
    return rows.withColumn(name, F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))


def metrics_json(metrics: DataFrame) -> DataFrame:
    """A row of metrics as one JSON text with sorted keys."""
    return metrics.select(F.to_json(F.struct(*(F.col(c) for c in sorted(metrics.columns))), {"ignoreNullFields": "false"}).alias("metrics"))

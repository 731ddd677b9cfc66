"""Generated equivalence classes: protein variants drawn by hashes, and laboratory values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiform.functions.text import format_g, status

#: One-letter code, three-letter code and name of each amino acid.
AMINO_ACIDS = [
    ("A", "Ala", "alanine"), ("R", "Arg", "arginine"), ("N", "Asn", "asparagine"), ("D", "Asp", "aspartic acid"),
    ("C", "Cys", "cysteine"), ("Q", "Gln", "glutamine"), ("E", "Glu", "glutamic acid"), ("G", "Gly", "glycine"),
    ("H", "His", "histidine"), ("I", "Ile", "isoleucine"), ("L", "Leu", "leucine"), ("K", "Lys", "lysine"),
    ("M", "Met", "methionine"), ("F", "Phe", "phenylalanine"), ("P", "Pro", "proline"), ("S", "Ser", "serine"),
    ("T", "Thr", "threonine"), ("W", "Trp", "tryptophan"), ("Y", "Tyr", "tyrosine"), ("V", "Val", "valine"),
]
#: Gene and its transcript.
GENES = [
    ("BRAF", "NM_004333.6"), ("EGFR", "NM_005228.5"), ("TP53", "NM_000546.6"), ("KRAS", "NM_004985.5"),
    ("PIK3CA", "NM_006218.4"), ("BRCA1", "NM_007294.4"), ("BRCA2", "NM_000059.4"), ("ALK", "NM_004304.5"),
]
#: Base changes.
BASES = [("A", "T"), ("C", "G"), ("G", "A"), ("T", "C")]
#: Name, unit, other unit, factor, reference range and values of each laboratory test.
LABS = [
    ("glucose", "mg/dL", "mmol/L", 0.0555, 70.0, 99.0, [62.0, 85.0, 126.0, 180.0]),
    ("creatinine", "mg/dL", "umol/L", 88.4, 0.7, 1.3, [0.6, 1.0, 1.8, 3.2]),
    ("sodium", "mmol/L", "mEq/L", 1.0, 135.0, 145.0, [128.0, 140.0, 151.0]),
    ("hemoglobin", "g/dL", "g/L", 10.0, 12.0, 16.0, [8.5, 13.7, 17.2]),
]


def _draw(what: str, n: int, seed: int) -> Column:
    """A number below n from the row's id, the seed and the draw's name."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", F.col("id").cast("string"), F.lit(str(seed)), F.lit(what))), 1, 8), 16, 10).cast("long") % n).cast("int")


def _pick(rows: list[tuple], field: int, at: Column) -> Column:
    return F.element_at(F.array(*(F.lit(r[field]) for r in rows)), at + 1)


def _form(text: Column, notation: str) -> Column:
    return F.struct(text.alias("text"), F.lit(notation).alias("notation"))


def _attrs(**values: Column) -> Column:
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v.cast("string"))))


def _classes(df: DataFrame, fact: Column, track: str, forms: list[Column], attrs: Column) -> DataFrame:
    lists = F.create_map().cast("map<string,array<string>>")
    return df.select(fact.alias("fact_id"), F.lit(track).alias("track"), F.array(*forms).alias("forms"), attrs.alias("attrs"), lists.alias("attr_lists"))


def variants(spark: SparkSession, n: int, seed: int = 13) -> DataFrame:
    """n variant classes; draws repeat for equal seeds and do not depend on the partitioning."""
    df = spark.range(n).select(
        _draw("gene", 8, seed).alias("g"), _draw("ref", 20, seed).alias("r"), _draw("alt", 19, seed).alias("a"), (_draw("pos", 1196, seed) + 5).alias("pos"), _draw("phase", 3, seed).alias("phase"), _draw("base", 4, seed).alias("b")
    )
    df = df.withColumn("a", F.col("a") + (F.col("a") >= F.col("r")).cast("int"))  # never the reference itself
    v = {"gene": _pick(GENES, 0, F.col("g")), "transcript": _pick(GENES, 1, F.col("g")), "from": _pick(BASES, 0, F.col("b")), "to": _pick(BASES, 1, F.col("b"))}
    v |= {f"{side}{k}": _pick(AMINO_ACIDS, k, F.col(side)) for side in ("r", "a") for k in range(3)}
    df = df.select((F.col("pos") * 3 - F.col("phase")).alias("cdna"), F.col("pos").cast("string").alias("p"), "pos", *(c.alias(k) for k, c in v.items()))
    c, l = F.col, F.lit
    # The wording and the notation of each form.
    forms = [
        _form(F.concat("gene", l(" "), "r0", "p", "a0"), "protein_one_letter"),
        _form(F.concat("gene", l(" p."), "r1", "p", "a1"), "protein_three_letter"),
        _form(F.concat("gene", l(" "), "r1", "p", "a1"), "protein_three_letter_short"),
        _form(F.concat("transcript", l(":c."), c("cdna").cast("string"), "from", l(">"), "to"), "cdna_hgvs_like"),
        _form(F.concat(l("missense variant in "), "gene", l(" changing "), "r2", l(" to "), "a2", l(" at protein position "), "p"), "text_description"),
    ]
    attrs = _attrs(
        gene=c("gene"), transcript=c("transcript"), protein_position=c("pos"), reference_aa_1=c("r0"), reference_aa_3=c("r1"), reference_aa_name=c("r2"),
        alternate_aa_1=c("a0"), alternate_aa_3=c("a1"), alternate_aa_name=c("a2"), cdna_position=c("cdna"), reference_base=c("from"), alternate_base=c("to"), mutation_type=l("missense"),
    )
    return _classes(df, F.concat(l("variant:"), "gene", l(":p."), "r1", "p", "a1"), "variant", forms, attrs)


def labs(spark: SparkSession) -> DataFrame:
    """One class for each listed value."""
    rows = spark.createDataFrame(LABS, "name string, unit string, other string, factor double, low double, high double, vals array<double>")
    df = rows.withColumn("value", F.explode("vals")).withColumn("changed", F.col("value") * F.col("factor")).withColumn("status", status(F.col("value"), F.col("low"), F.col("high")))
    c, l = F.col, F.lit
    # The wording and the notation of each form.
    forms = [
        _form(F.concat("name", l(" "), format_g(c("value")), l(" "), "unit"), "canonical_unit"),
        _form(F.concat("name", l(" "), format_g(c("changed"), 3), l(" "), "other"), "alternate_unit"),
        _form(F.concat("name", l(" reference range "), format_g(c("low")), l("-"), format_g(c("high")), l(" "), "unit"), "reference_range"),
        _form(F.concat("name", l(" is "), "status"), "text_interpretation"),
    ]
    attrs = _attrs(lab_name=c("name"), canonical_value=c("value"), canonical_unit=c("unit"), alternate_value=c("changed"), alternate_unit=c("other"), reference_low=c("low"), reference_high=c("high"), status=c("status"))
    return _classes(df, F.concat(l("lab:"), "name", l(":"), format_g(c("value")), l(":"), "unit"), "lab", forms, attrs)

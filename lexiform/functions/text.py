"""Column expressions over single values: cleaning, splitting, parsing, byte and n-gram views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: All Unicode white space; trim() without a list removes spaces alone.
_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
#: The patterns of positions and of plain numbers.
PROTEIN = r":p\.[A-Za-z*=()?_\[\]-]*?([0-9]+)"
NUCLEOTIDE = r":[cgnmr]\.([*-]?[0-9]+)"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def let(value: Column, use) -> Column:
    """use(value) with value computed once a row, however often it is used, also inside lambdas."""
    return F.transform(F.array(value), use)[0]


def strip(c: Column) -> Column:
    """Text without white space at its ends; null counts as empty."""
    return F.btrim(F.coalesce(c, F.lit("")), F.lit(_SPACE))


def unquote(c: Column) -> Column:
    """strip(), then without double quotes at the ends; white space inside the quotes stays."""
    return F.btrim(strip(c), F.lit('"'))


def clean(c: Column, nulls: tuple[str, ...] = ("-",)) -> Column:
    """unquote(), with the markers of missing values as empty."""
    return F.when(unquote(c).isin(*nulls), F.lit("")).otherwise(unquote(c))


def clean_summary(c: Column) -> Column:
    return clean(c, ("-", "na"))


def split_values(c: Column, sep: str = "|", nulls: tuple[str, ...] | None = None) -> Column:
    """The trimmed parts between separators, without empty ones; with nulls, without those that clean() empties."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), rf"\Q{sep}\E", -1), strip)
    return F.filter(parts, (lambda p: p != "") if nulls is None else (lambda p: clean(p, nulls) != ""))


def protein_position(c: Column) -> Column:
    """The first number after ``:p.``, else null."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), PROTEIN, 1).try_cast("bigint")


def nucleotide_position(c: Column) -> Column:
    """The signed number after ``:c.`` and the like (a leading ``*`` dropped), else null."""
    return F.regexp_replace(F.regexp_extract(F.coalesce(c, F.lit("")), NUCLEOTIDE, 1), r"^\*", "").try_cast("bigint")


def position_of(c: Column, field: str) -> Column:
    """The value that a form states for a position attribute, null if it states none."""
    if field == "protein_position":
        return protein_position(c)
    if field in ("nucleotide_position", "cdna_position", "genomic_position"):
        return nucleotide_position(c)
    return F.lit(None).cast("bigint")


def number(c: Column) -> Column:
    """A plain decimal number as double, else null."""
    return let(strip(c.cast("string")), lambda text: F.when(text.rlike(NUMBER), text.try_cast("double")))


def attribute(c: Column) -> Column:
    """A trimmed attribute value; empty is null."""
    return F.nullif(strip(c.cast("string")), F.lit(""))


def mask_digits(c: Column) -> Column:
    return F.regexp_replace(c, "[0-9]", "#")


def strip_digits(c: Column) -> Column:
    return F.regexp_replace(c, "[0-9]", "")


def byte_ids(c: Column, max_length: int) -> Column:
    """UTF-8 bytes plus one, cut to max_length and padded with zeros."""
    digits = F.hex(F.substring(F.encode(F.coalesce(c, F.lit("")), "UTF-8"), 1, max_length))
    n = F.length(digits) / 2
    at = lambda i: F.conv(F.substr(digits, i * 2 - 1, F.lit(2)), 16, 10).cast("int") + 1
    return F.transform(F.sequence(F.lit(1), F.lit(max_length)), lambda i: F.when(i <= n, at(i)).otherwise(0))


def byte_mask(ids: Column) -> Column:
    return F.transform(ids, lambda i: (i > 0).cast("double"))


def char_ngrams(c: Column, low: int = 2, high: int = 5) -> Column:
    """All n-grams of code points of the lower-cased text between two spaces, with repeats."""
    text = F.concat(F.lit(" "), F.lower(F.coalesce(c, F.lit(""))), F.lit(" "))
    size = F.length(text)
    of = lambda n: F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substr(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.concat(*(of(n) for n in range(low, high + 1)))


def format_g(c: Column, digits: int = 6) -> Column:
    """A number as ``%.<digits>g`` writes it, for magnitudes that need no exponent: no trailing zeros."""
    whole = F.when(c == 0, F.lit(1)).otherwise(F.floor(F.log10(F.abs(c))).cast("int") + 1)
    out = F.lit(None).cast("string")
    for k in range(-3, digits + 1):
        shown = F.format_string(f"%.{max(0, digits - k)}f", F.bround(c, max(0, digits - k)))
        out = F.when(whole == k, shown).otherwise(out)
    return F.when(out.contains("."), F.regexp_replace(out, r"\.?0+$", "")).otherwise(out)


def status(value: Column, low: Column, high: Column) -> Column:
    """low, normal or high by a reference range that includes both ends."""
    return F.when(value < low, "low").when(value > high, "high").otherwise("normal")


def shuffle_key(c: Column, seed: int) -> Column:
    """Sort by this, then by the id itself: a shuffle that SQL engines repeat."""
    return F.md5(F.concat(c.cast("string"), F.lit(f"|{seed}")))


def ascii_json(c: Column) -> Column:
    """JSON text with all characters beyond ASCII as escapes of their UTF-16 units."""
    units = F.regexp_extract_all(F.hex(F.encode(c, "UTF-16BE")), F.lit("...."), F.lit(0))
    shown = F.transform(units, lambda u: F.when(u < "0080", F.char(F.conv(u, 16, 10).cast("bigint"))).otherwise(F.concat(F.lit("\\u"), F.lower(u))))
    return F.when(c.rlike(r"[^\x00-\x7f]"), F.array_join(shown, "")).otherwise(c)


def sorted_value(c: Column, kind: T.DataType) -> Column:
    """A value with its struct fields and map keys in order, at every depth."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(c.isNotNull(), F.named_struct(*(x for f in fields for x in (F.lit(f.name), sorted_value(c[f.name], f.dataType)))))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: sorted_value(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.transform(F.array_sort(F.map_keys(c)), lambda k: F.struct(k.alias("key"), sorted_value(c[k], kind.valueType).alias("value"))))
    return c

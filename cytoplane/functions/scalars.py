"""Scalar expressions: sequences, stars, effect sizes, angles, attribute strings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The published Kyte-Doolittle hydropathy scale.
HYDROPATHY = {
    "A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5,
    "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2,
}


def gravy(s: Column) -> Column:
    """Mean hydropathy of the residues after gaps are removed; null for an empty sequence or an unknown residue."""
    scale = F.create_map(*[F.lit(x) for kv in HYDROPATHY.items() for x in kv])
    clean = F.translate(s, "-", "")
    total = F.aggregate(F.filter(F.split(clean, ""), lambda c: c != ""), F.lit(0.0), lambda acc, c: acc + F.try_element_at(scale, c))
    return F.try_divide(total, F.nullif(F.length(clean), F.lit(0)))


def stars(p: Column, most: int = 4) -> Column:
    """'n.s.' from 0.05 on, one star below, and from 0.01 down one per power of ten, at most ``most``. Raises outside 0 to 1."""
    many = F.when(p <= 10.0**-most, most).otherwise(F.least(F.lit(most), F.floor(-F.log10(F.nullif(p, F.lit(0.0))))).cast("int"))
    out = F.when(p >= 0.05, "n.s.").when(p < 0.01, F.repeat(F.lit("*"), many)).otherwise("*")
    return F.when((p < 0) | (p > 1), F.raise_error("p-value outside [0, 1]")).otherwise(F.when(p.isNotNull(), out))


def cohens_d(value: str, group: str, first, second) -> Column:
    """An aggregate: difference of means over the pooled sample deviation."""
    v = lambda g: F.when(F.col(group) == F.lit(g), F.col(value))
    n1, n2 = F.count(v(first)), F.count(v(second))
    pooled = F.sqrt(F.try_divide((n1 - 1) * F.var_samp(v(first)) + (n2 - 1) * F.var_samp(v(second)), n1 + n2 - 2))
    return F.try_divide(F.avg(v(first)) - F.avg(v(second)), pooled)


def glass_delta(value: str, group: str, experimental, control) -> Column:
    """An aggregate: difference of means over the control's sample deviation."""
    v = lambda g: F.when(F.col(group) == F.lit(g), F.col(value))
    return F.try_divide(F.avg(v(experimental)) - F.avg(v(control)), F.stddev_samp(v(control)))


def angle_degrees(y: Column, x: Column) -> Column:
    """The angle of (x, y) from the direction of (-1, -1), in [0, 360)."""
    import math

    a = F.atan2(y, x) - math.atan2(-1, -1)
    return F.degrees(F.when(a < 0, a + 2 * math.pi).otherwise(a))


def path_parent(path: Column, sep: str = "-") -> Column:
    """'0-3-1' to '0-3'; null for a root."""
    last = re.escape(sep) + f"[^{re.escape(sep)}]*$"
    return F.when(F.contains(path, F.lit(sep)), F.regexp_replace(path, last, ""))


def path_level(path: Column, sep: str = "-") -> Column:
    return F.size(F.split(path, re.escape(sep))) - 1


#: Attributes of a gene annotation line that get the exon number.
EXON_KEYS = ("gene_id", "gene_name", "transcript_id", "transcript_name", "ccds_id")


def exon_attributes(attribute: Column, transcript_as_gene: bool = False) -> Column:
    """'-exonN' put inside the quotes of the gene, transcript and ccds keys; with transcript_as_gene, the gene's id and
    name become the transcript's first. Lines without an exon number stay as they are."""
    number = F.regexp_extract(attribute, r'exon_number "?([0-9]+)"?', 1)
    out = attribute
    if transcript_as_gene:
        for kind in ("id", "name"):
            value = F.regexp_extract(attribute, rf'transcript_{kind} "([^"]*)"', 1)
            out = F.when(value != "", F.regexp_replace(out, F.lit(rf'gene_{kind} "[^"]*"'), F.concat(F.lit(f'gene_{kind} "'), value, F.lit('"')))).otherwise(out)
    for key in EXON_KEYS:
        out = F.regexp_replace(out, F.lit(rf'(\b{key} "[^"]*)"'), F.concat(F.lit("$1-exon"), number, F.lit('"')))
    return F.when(number != "", out).otherwise(attribute)


def split_exons(gtf: DataFrame, genes: list[str] | None = None, transcript_as_gene: bool = False) -> DataFrame:
    """Exon rows with rewritten attributes for the named genes (all if none are named), others unchanged."""
    exons = gtf.where(F.col("feature") == "exon")
    hit = F.lit(True)
    if genes:
        hit = F.lit(False)
        for g in genes:
            hit = hit | F.contains("attribute", F.lit(f'gene_name "{g}"'))
    return exons.withColumn("changed", hit).withColumn("attribute", F.when(hit, exon_attributes(F.col("attribute"), transcript_as_gene)).otherwise(F.col("attribute")))


#: Longest operators first, so that <= isn't read as <.
PREDICATE = re.compile(r"^\s*(\S+)\s*(==|!=|<=|>=|<|>)\s*(.+?)\s*$")


def predicate(df: DataFrame, queries: list[str]) -> Column:
    """The conjunction of "field op value" texts; values are cast to the field's type."""
    out = F.lit(True)
    kinds = dict(df.dtypes)
    for q in queries:
        m = PREDICATE.match(q)
        if not m or m[1] not in kinds:
            raise ValueError(f"cannot read the predicate {q!r}")
        field, value = F.col(m[1]), F.lit(m[3]).cast(kinds[m[1]])
        out = out & {"==": field == value, "!=": field != value, "<": field < value, "<=": field <= value, ">": field > value, ">=": field >= value}[m[2]]
    return out


def text_number(s: Column) -> Column:
    """A text as the hexadecimal digits of its bytes, and back with number_text."""
    return F.hex(F.encode(s, "UTF-8"))


def number_text(h: Column) -> Column:
    return F.decode(F.unhex(h), "UTF-8")


def hamming(a: Column, b: Column) -> Column:
    """Differing places of equally long texts; null otherwise."""
    d = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda acc, v: acc + v)
    return F.when(F.length(a) == F.length(b), d)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null if either is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))

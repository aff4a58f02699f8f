"""Text expressions: header lines, flags, species names, sequences, tree labels, labels and colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import AMINO_ACIDS

# fixed values: flag and its pattern, looked for anywhere, letters in either case
FLAGS = {
    "structure": "crystal structure",
    "low_quality": "low.quality",
    "predicted": "predicted",
    "precursor": "precursor",
    "isoform": "isoform",
    "hypothetical": "hypothetical",
    "partial": "partial",
}


def flag(line: Column, name: str) -> Column:
    return F.coalesce(line.rlike(f"(?i){FLAGS[name]}"), F.lit(False))


def flags(line: Column) -> list[Column]:
    """The seven quality flags of a header line, as named columns."""
    return [flag(line, f).alias(f) for f in FLAGS]


def _entry_accession(entry: Column) -> Column:
    fields = F.split(entry, r"\|")
    n = F.size(fields)
    pdb = F.concat_ws("_", F.trim(F.get(fields, F.lit(1))), F.get(F.split(F.trim(F.get(fields, F.lit(2))), r"\s+"), F.lit(0)))
    plain = F.regexp_extract(F.trim(F.get(fields, n - 2)), r"^([^.]*)", 1)
    return F.when(n < 3, F.lit(None).cast("string")).when(F.lower(F.trim(F.get(fields, F.lit(0)))) == "pdb", pdb).otherwise(F.nullif(plain, F.lit("")))


def parse_header(line: Column, accession: Column | None = None) -> Column:
    """struct(accession, species, name, line) of a database header line, null where no entry can be read.

    A line may hold several entries separated by '>'. Asked for, the entry of that accession is taken,
    else the first that can be read. The species is the last bracketed text, and with nested brackets
    ('[[Genus] species]') all of it; the name is what stands after the last bar and before the bracket.
    """
    entries = F.filter(F.transform(F.split(F.regexp_replace(line, "^>", ""), ">"), lambda e: F.trim(e)), lambda e: F.coalesce(_entry_accession(e) != "", F.lit(False)))
    first = F.get(entries, F.lit(0))
    chosen = first if accession is None else F.coalesce(F.get(F.filter(entries, lambda e: _entry_accession(e) == F.regexp_extract(accession, r"^([^.]*)", 1)), F.lit(0)), first)
    nested = F.regexp_extract_all(chosen, F.lit(r"\[(\[[^\[\]]*\][^\[\]]*)\]"), F.lit(1))
    plain = F.regexp_extract_all(chosen, F.lit(r"\[([^\[\]]*)\]"), F.lit(1))
    species = F.when(F.size(nested) > 0, F.element_at(nested, -1)).when(F.size(plain) > 0, F.element_at(plain, -1))
    tail = F.substring_index(chosen, "|", -1)
    name = F.replace(F.trim(F.substring_index(tail, "[", 1)), F.lit("  "), F.lit(" "))
    made = F.struct(_entry_accession(chosen).alias("accession"), species.alias("species"), name.alias("name"), chosen.alias("line"))
    return F.when(chosen.isNotNull() & species.isNotNull() & (name != ""), made)


def without_strain(species: Column) -> Column:
    """A species name without what 'strain' or 'str.' begins."""
    return F.trim(F.regexp_replace(F.regexp_replace(species, r"(?i)strain.*", ""), r"(?i)str\..*", ""))


def clean_sequence(seq: Column) -> Column:
    """All but the twenty amino-acid letters and '-' become '-'."""
    return F.regexp_replace(seq, f"[^{AMINO_ACIDS}-]", "-")


def protect_name(name: Column) -> Column:
    """A label that trees can hold: blanks as %20, in quotes."""
    return F.concat(F.lit("'"), F.replace(name, F.lit(" "), F.lit("%20")), F.lit("'"))


def unprotect_name(name: Column) -> Column:
    return F.replace(F.regexp_replace(name, "^'|'$", ""), F.lit("%20"), F.lit(" "))


def disambiguated(df: DataFrame, label: Column, key: str, into: str = "label", separator: str = "|") -> DataFrame:
    """Labels; those that several rows have get the row's key behind them.

    How often a label occurs is counted by aggregation and joined, so that one very common label does
    not gather its rows in one task.
    """
    held = df.withColumn(into, label)
    often = held.groupBy(into).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(into).alias("_l"))
    joined = held.join(often, held[into].eqNullSafe(often["_l"]), "left")
    return joined.withColumn(into, F.when(F.col("_l").isNotNull(), F.concat_ws(separator, F.col(into), F.col(key).cast("string"))).otherwise(F.col(into))).drop("_l")


def labels(df: DataFrame, columns: list[str] | None = None, key: str = "uid", separator: str = "|", disambiguate: bool = True) -> DataFrame:
    """key and label of kept rows, from columns joined; by default species and the first 10 letters of the name."""
    if columns:
        text = F.concat_ws(separator, *[F.col(c).cast("string") for c in columns])
        rows = df.where("keep") if "keep" in df.columns else df
    else:
        short = F.when(F.length("name") > 10, F.concat(F.substring("name", 1, 10), F.lit("..."))).otherwise(F.col("name"))
        text, rows = F.concat_ws(separator, F.col("species"), short), df
    out = disambiguated(rows, text, key, "label", separator) if disambiguate else rows.withColumn("label", text)
    return out.select(key, "label")


def text_uid(*parts: Column) -> Column:
    """Ten letters that follow from the row's content."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    h = F.xxhash64(*parts)
    g = F.xxhash64(F.lit(17), *parts)
    letter = lambda x, i: F.substring(F.lit(alphabet), F.pmod(F.shiftrightunsigned(x, 11 * i), F.lit(52)).cast("int") + 1, 1)
    return F.concat(*[letter(h, i) for i in range(5)], *[letter(g, i) for i in range(5)])


def css_color(value: object) -> str:
    """'#rrggbb' of a name, a '#...' string, or three or four numbers in 0..1 or 0..255."""
    if isinstance(value, str):
        return value
    v = [float(x) for x in value][:3]
    if max(v) <= 1:
        v = [255 * x for x in v]
    return "#" + "".join(f"{round(min(max(x, 0), 255)):02x}" for x in v)


def blend(low: str, high: str, share: float) -> str:
    """Colour between two '#rrggbb' colours."""
    a, b = (tuple(int(c[i : i + 2], 16) for i in (1, 3, 5)) for c in (low, high))
    return css_color([x + (y - x) * min(max(share, 0), 1) for x, y in zip(a, b, strict=True)] if max(*a, *b) > 1 else [0, 0, 0])


def run_ids(value: Column, partition: list[str], order: list[str]) -> Column:
    """Number of a run of equal values in its partition, from 1 (null counts as a value)."""
    w = Window.partitionBy(*partition).orderBy(*order)
    before = F.lag(F.struct(value.alias("v"))).over(w)
    changed = F.when(before.isNull() | ~F.struct(value.alias("v")).eqNullSafe(before), 1).otherwise(0)
    return F.sum(changed).over(w.rowsBetween(Window.unboundedPreceding, 0))

"""Column names and types shared by readers and operators."""

from __future__ import annotations

# fixed values: column names that tables of this kind have, in files too
REQUIRED = ["species", "name", "sequence"]
RESERVED = [*REQUIRED, "uid", "ott", "alignment", "keep", "always_keep"]
NEWICK_RESERVED = "();#:,'\""
ROW = "row_id"
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"

# fixed values: columns of hit and site tables
HITS = (
    "accession string, hit_def string, hit_id string, title string, length int, e_value double, bits double, "
    "sequence string, subject_start int, subject_end int, query_start int, query_end int, query string"
)
SITES = "anc string, site int, gap boolean, ml_state string, ml_pp double, alt_state string, alt_pp double, site_type string, entropy double"
# fixed values: flags of a header, in the order in which they decide
QUALITY_FLAGS = ["low_quality", "partial", "predicted", "precursor", "hypothetical", "isoform", "structure"]


class TableError(ValueError):
    """Input that breaks a table's rules."""

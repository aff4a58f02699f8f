"""kinlattice: a Spark-first engine for protein-family tables.

Every operator takes and returns DataFrames; nothing runs until an action.
"""

__version__ = "0.1.0"

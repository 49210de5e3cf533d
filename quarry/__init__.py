"""quarry: a Spark-native engine for analytics over corpora of source code.

Every operator takes and returns DataFrames; the only Python stage is the
facts job in :mod:`quarry.plans.facts`, which parses files inside Arrow
batches. See README.md for the operator inventory.
"""

__version__ = "0.1.0"

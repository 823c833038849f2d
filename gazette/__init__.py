"""gazette: a Spark-native news digest engine.

Articles are DataFrames; every stage (collection, relevance gate,
classification, clustering, digest, store, statistics) is a function from
DataFrames to a lazy DataFrame, so Catalyst plans whole pipelines at once.
"""

__version__ = "0.1.0"

"""Explainable segmentation on Spark.

Clean path-like strings, collapse long-tail categories, index categories by
frequency, rank features by random-forest importance, fit a shallow decision
tree and turn every leaf into a readable predicate reported with prediction,
probability, coverage and frequency.  Every step is DataFrame in, DataFrame
out; the heavy work (scans, joins, aggregations, model fitting) runs on the
cluster, and only model-sized tables (tree nodes, top-N lists, category labels)
ever reach the driver.
"""

__version__ = "0.1.0"

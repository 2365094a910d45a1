"""Lexiqua: text analytics and classifier evaluation as Spark jobs.

Sub-packages
------------
functions   column expressions (cleaning, tokens, scores)
operators   DataFrame -> DataFrame jobs (features, profiles, corpus, sampling, models, evaluation)
plans       shared physical patterns (staged tables, ordered blocks, skew-safe joins, neighbours)
sources     files in and out
streaming   incremental ingest
registry    bindings to the test tables and their SQL oracles
"""

__version__ = "0.1.0"

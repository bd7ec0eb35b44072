"""Training-data pipeline operators: filtering, deduplication, extraction, privacy, packing, scoring and search.

Nothing outside this package imports it.  Every operator is a function of DataFrames and parameters; ``queries.py`` binds
them to the tables and derives the digest columns.
"""

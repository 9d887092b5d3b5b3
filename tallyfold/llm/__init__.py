"""Training-data operators: packing, extraction, binary output, archives, quality, dedup.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; the thin ``opN_*`` queries that register them live in ``queries.py``.
"""

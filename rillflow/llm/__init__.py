"""Training-data operators: dedup, quality, tokenisation, mixing and media columns.

Nothing outside this package imports it.  ``registry`` lists its queries.
"""

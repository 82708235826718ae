"""Training-data operators: deduplication, packing, tokenising, scoring, filtering and vector search.

Every operator is a function from DataFrames to a DataFrame.  Nothing outside
this subpackage imports it.
"""

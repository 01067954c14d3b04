"""Training-data operators: formatting, filtering, deduplication, scoring, search and packing.

Nothing outside this subpackage imports it.  Every operator takes and returns DataFrames, reads
``spark.checkpoint.dir`` for shared scratch space and keeps text in the executors.
"""

"""Training-data operators: packing, tokenising, sharding, scoring, deduplication, search.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is there.
"""

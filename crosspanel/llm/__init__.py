"""Training-data operators: fingerprints, similarity joins, filters, tokens, packing, shards, search.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is there.
"""

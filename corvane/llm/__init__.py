"""Training-data operators: quality, toxicity, duplicates, tokens, packing, sharding.

Nothing outside this package imports it; ``queries.py`` lists its queries.
"""

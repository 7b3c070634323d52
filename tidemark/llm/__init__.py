"""Training-data operators: sharding, token counts, mixing, near-duplicates, media, search, text.

Nothing else in the library imports this subpackage.
"""

"""Training-data operators: deduplication, quality, tokenising, packing, web archives.

Every operator takes DataFrames and returns a DataFrame; the thin queries over the
synthetic tables are in :mod:`foliospark.llm.queries`.
"""

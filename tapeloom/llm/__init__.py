"""Training-data operators: chat formatting, near duplicates, language, quality, tokens, search, packing, records.

Nothing outside this folder imports it; ``queries.py`` holds the registered queries.
"""

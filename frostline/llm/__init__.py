"""Training-data operators: dedup, scans, quality, packing, language and LM scoring.

Nothing outside this folder imports it.  ``queries.py`` holds the registered queries.
"""

"""Training-data operators for large text corpora (language ID, toxicity, dedup, packing, ...).

Nothing outside this subpackage imports it.
"""

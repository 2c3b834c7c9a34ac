"""Training-data operators: quality, decontamination, toxicity, tokens, dedup, sharding, language.

Nothing else in the library imports this subpackage.
"""

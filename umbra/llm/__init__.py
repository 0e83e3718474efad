"""Training-data operators: deduplication, quality, decontamination, mixing, secrets, toxicity.

Nothing else in the library imports this subpackage.
"""

"""Training-data operators: packing, toxicity, search, mixing, secrets, joins, quality, scoring, licences, PII.

Nothing else in the package imports this subpackage.
"""

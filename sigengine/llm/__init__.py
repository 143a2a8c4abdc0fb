"""Training-data operators: quality, scoring, de-duplication, PII, packing.

Nothing else in the library imports this subpackage; ``queries`` lists its registered queries.
"""

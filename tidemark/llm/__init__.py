"""Training-data operators: scans, deduplication, scoring, decontamination, mixing.

Nothing else in the library imports this package.
"""

"""Operators for preparing training text: identification, scoring, deduplication, decontamination and mixing.

Nothing else in the package imports this subpackage; ``queries`` registers one query per operator.
"""

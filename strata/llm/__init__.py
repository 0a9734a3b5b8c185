"""Operators of a training-data pipeline: filtering, deduplication, scoring, tokenizing.

Nothing else in the library imports this subpackage; it only borrows general
helpers (session, checkpoint folder).  Registered queries are in ``queries``.
"""

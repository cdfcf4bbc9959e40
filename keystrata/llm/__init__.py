"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it.  Each module holds one operator and the thin
``opN_*`` query that derives the contract's columns from it; ``llm.queries`` collects them.
"""

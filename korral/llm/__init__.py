"""Training-data operators: dedup, joins, classifiers, extraction, mixing.

Nothing outside this subpackage imports it.  Each operator module has a general
interface; the thin contract queries are in :mod:`korral.llm.queries`.
"""

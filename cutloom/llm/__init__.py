"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; its thin ``opN_*`` query lives in :mod:`cutloom.llm.queries`.
"""

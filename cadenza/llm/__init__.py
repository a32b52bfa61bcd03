"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Each module holds one operator with a
general interface plus the thin ``opN_*`` query over the standard tables;
:mod:`cadenza.llm.queries` gathers the queries and their SQL.
"""

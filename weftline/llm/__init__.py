"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; its queries and SQL are in
:mod:`weftline.llm.queries`.
"""

"""Operators for building training corpora from documents.

Nothing outside this subpackage imports it.  Every operator takes and returns
Spark DataFrames; the thin queries registered for the driver are in
``gridloom.llm.queries``.
"""

"""Operators for preparing text corpora for language-model training.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; `queries` binds them to the tables of a data directory.
"""

"""Operators for building language-model training data, all on Spark DataFrames.

Nothing outside this subpackage imports it.  Each module holds one operator;
``queries`` applies them to the tables of a data folder.
"""

"""Operators for preparing language-model training data at scale.

Every operator takes a DataFrame and column names and reads nothing else of the row, so
extra columns, whatever they are called, do no harm.
"""

"""Operators for preparing language-model training corpora at cluster scale.

Nothing outside this subpackage imports it; every operator is a plain function
from DataFrames to a DataFrame and works on whole tables.
"""

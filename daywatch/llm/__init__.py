"""Operators for preparing language-model training data.

Each module holds one operator: DataFrames and parameters in, a DataFrame out. All
columns that an operator does not name pass through untouched. Working columns get
names that the input does not use.
"""

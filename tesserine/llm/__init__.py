"""Operators for preparing language-model training data, each a function on a DataFrame of documents."""

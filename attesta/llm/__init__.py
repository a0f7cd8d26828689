"""Operators for preparing language-model training data. Nothing else in attesta imports this subpackage."""

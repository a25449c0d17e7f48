"""Operators for large text corpora used as training data. Nothing else in winlens imports this subpackage."""

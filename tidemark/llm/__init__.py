"""Operators of a training-data pipeline. Nothing else in tidemark imports this subpackage."""

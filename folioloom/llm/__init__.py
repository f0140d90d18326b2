"""Operators for large training-text pipelines. Nothing outside imports this subpackage."""

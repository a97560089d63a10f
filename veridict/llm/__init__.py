"""Operators for large training-text pipelines. Nothing else in veridict imports this subpackage."""

"""Operators of a large-scale training-data pipeline.

The rest of the library never imports this subpackage.
"""

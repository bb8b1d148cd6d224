"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it, apart from the guarded import in
the driver's entry module and the corpus pipeline.
"""

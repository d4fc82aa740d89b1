"""Operators for large training-data pipelines.

Nothing outside this folder imports it; the root entry module adds its queries when it is present.
"""

"""Operators for large training-data pipelines. Nothing else in quantloom imports this subpackage.

Each module holds one operator with a general interface; ``queries`` holds the thin digest queries.
"""

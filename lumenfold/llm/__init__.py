"""Operators of a training-data pipeline over text, vectors and web pages.

Nothing else in the package imports this subpackage. Each module holds one operator with its
general interface; ``queries`` binds them to the tables with production parameters.
"""

"""Operators for preparing training data, one module each.

Nothing else in the library imports this package. ``registry`` holds the queries
and the SQL twins that ``__spark_entry__.py`` adds.
"""

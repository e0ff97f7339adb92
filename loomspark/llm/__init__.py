"""Operators for preparing training data at corpus scale.

Nothing else in the library imports this subpackage. Each operator is a module with a general
interface; ``registry`` holds the queries over the given tables and, where SQL can express one, its SQL.
"""

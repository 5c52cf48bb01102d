"""Operators for preparing training text at scale.

Nothing else in the library imports this subpackage; it may be deleted whole.
Every operator takes a DataFrame and returns one, reads whole tables, and keeps
intermediate tables only in the shared folder of ``spark.checkpoint.dir``.
"""

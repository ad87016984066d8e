"""Operators of a training-data pipeline. Nothing else in the library imports
this subpackage; see README for the list and ``queries.py`` for the registry."""

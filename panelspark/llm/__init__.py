"""Operators of a training-data pipeline over the texts and profiles of the territorial records.

Nothing else in the library imports this subpackage.
"""

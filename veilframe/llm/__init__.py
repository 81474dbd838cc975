"""Operators of a training-data pipeline: packing, duplicate search, archives, language, scoring, mixing.

Every operator takes and returns DataFrames. Nothing else in the library imports this subpackage.
"""

"""Corpus operators for training-data pipelines.

The subpackage stands alone: nothing else in the library imports it, and it
imports nothing from the rest of the library.
"""

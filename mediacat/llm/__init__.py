"""Preparation of the catalog's texts and vectors as training data.

Nothing else in the library imports this folder.
"""

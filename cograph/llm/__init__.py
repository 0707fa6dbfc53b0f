"""Operators for building large training-data sets."""

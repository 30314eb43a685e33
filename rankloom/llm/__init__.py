"""Operators for preparing training text: one module for each, over plain DataFrames."""

"""Operators over entity and relationship DataFrames."""

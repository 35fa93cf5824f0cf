"""Entity and relationship extraction from source files.

A file is one row, and everything about it is found inside that row with
built-in functions, so extraction is a narrow stage: the corpus is read once
and its text is never shuffled. Only the rows found leave the stage.
"""

from graphweft.extract.corpus import extract

__all__ = ["extract"]

"""Errors of the engine. Formula errors are values (their label), these are exceptions."""

from __future__ import annotations


class GridError(Exception):
    """Base of all errors; ``line`` is set when a script's statement raised it."""

    def __init__(self, message: str, line: int | None = None):
        super().__init__(f"line {line}: {message}" if line else message)
        self.message, self.line = message, line


class ParseError(GridError):
    pass


class ColumnMissing(GridError):
    pass


class DuplicateColumn(GridError):
    pass


class OutOfBounds(GridError):
    pass


class Unsupported(GridError):
    pass


# The labels of formula errors.
DIV0, NAME, VALUE, REF, NULL, NUM, NA = "#DIV/0!", "#NAME?", "#VALUE!", "#REF!", "#NULL!", "#NUM!", "#N/A"
LABELS = (DIV0, NAME, VALUE, REF, NULL, NUM, NA)

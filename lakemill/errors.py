"""Errors with Postgres wording and SQLSTATE codes, and the translation of Spark's."""

from __future__ import annotations

import re


class SqlError(Exception):
    """position: offset in the statement, if known."""

    def __init__(self, message: str, state: str = "XX000", position: int | None = None) -> None:
        super().__init__(message)
        self.message, self.state, self.position = message, state, position

    def caret(self, text: str) -> str:
        """The message with the line it points to."""
        if self.position is None:
            return self.message
        start = text.rfind("\n", 0, self.position) + 1
        line = text[start:].split("\n", 1)[0]
        return f"{self.message}\n{line}\n{' ' * (self.position - start)}^"


class ParseError(SqlError):
    def __init__(self, message: str, position: int) -> None:
        super().__init__(message, "42601", position)


class BindError(SqlError):
    pass


class ExecError(SqlError):
    pass


#: Patterns of a run-time message -> SQLSTATE.
STATES = (
    (r"division by zero", "22012"),
    (r"out of range", "22003"),
    (r"invalid input syntax", "22P02"),
    (r"negative substring length", "22011"),
    (r"more than one row returned", "21000"),
)
#: Spark's error conditions -> message here.
CONDITIONS = (
    ("DIVIDE_BY_ZERO", "division by zero"),
    ("REMAINDER_BY_ZERO", "division by zero"),
    ("ARITHMETIC_OVERFLOW", "bigint out of range"),
    ("CAST_OVERFLOW", "bigint out of range"),
    ("BINARY_ARITHMETIC_OVERFLOW", "bigint out of range"),
    ("SCALAR_SUBQUERY_TOO_MANY_ROWS", "more than one row returned by a subquery used as an expression"),
    ("INVALID_FORMAT.ESC_AT_THE_END", "LIKE pattern must not end with escape character"),
    ("INVALID_FORMAT", "invalid LIKE pattern"),
    ("UNSUPPORTED_SUBQUERY_EXPRESSION_CATEGORY", "this correlated subquery is not supported"),
)


def translated(error: Exception) -> SqlError:
    """A Spark exception as ours."""
    if isinstance(error, SqlError):
        return error
    text = str(error)
    raised = re.search(r"\[USER_RAISED_EXCEPTION\] (.*?)(?: SQLSTATE: \w+|\n|$)", text, re.S)
    message = raised[1] if raised else next((m for c, m in CONDITIONS if f"[{c}" in text), None)
    if message is None:
        return ExecError(text.split("\n")[0], "XX000")
    return ExecError(message, next((s for p, s in STATES if re.search(p, message)), "XX000"))

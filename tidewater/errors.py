"""Errors with SQL-Server-style numbers."""

from __future__ import annotations

#: Error numbers that clients test for.
SYNTAX, BAD_COLUMN, BAD_OBJECT, BAD_CONVERSION = 102, 207, 208, 245
BAD_DATABASE, DUPLICATE_COLUMN, DUPLICATE_OBJECT = 911, 2705, 2714
DIVIDE_BY_ZERO, BAD_CURSOR, OTHER, MERGE_CONFLICT = 8134, 16916, 50000, 8672
NULL_VIOLATION, KEY_VIOLATION, CHECK_VIOLATION, TRUNCATED, OVERFLOW = 515, 2627, 547, 2628, 8115


class SqlError(Exception):
    """What a statement raised: number, severity and state as TRY/CATCH sees them."""

    def __init__(self, message: str, number: int = OTHER, severity: int = 16, state: int = 1):
        super().__init__(message)
        self.message, self.number, self.severity, self.state = message, number, severity, state


#: Conditions of Spark's errors and the number that each stands for.
CONDITIONS = {
    "DIVIDE_BY_ZERO": DIVIDE_BY_ZERO,
    "REMAINDER_BY_ZERO": DIVIDE_BY_ZERO,
    "CAST_INVALID_INPUT": BAD_CONVERSION,
    "CAST_OVERFLOW": OVERFLOW,
    "ARITHMETIC_OVERFLOW": OVERFLOW,
    "NUMERIC_VALUE_OUT_OF_RANGE": OVERFLOW,
    "BINARY_ARITHMETIC_OVERFLOW": OVERFLOW,
    "UNRESOLVED_COLUMN": BAD_COLUMN,
    "TABLE_OR_VIEW_NOT_FOUND": BAD_OBJECT,
    "SCALAR_SUBQUERY_TOO_MANY_ROWS": 512,
    "PARSE_SYNTAX_ERROR": SYNTAX,
}


def from_spark(error: Exception) -> SqlError:
    """The engine's error for one that Spark raised."""
    get = getattr(error, "getCondition", None) or getattr(error, "getErrorClass", None)
    condition = (get() if get else "") or ""
    text = str(error)
    for name, number in CONDITIONS.items():
        if condition.startswith(name) or f"[{name}" in text:
            return SqlError("Divide by zero error encountered." if number == DIVIDE_BY_ZERO else text.split("\n")[0], number)
    return SqlError(text.split("\n")[0], OTHER)

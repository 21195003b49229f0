"""What is wrong with an expression or a ruleset, and where."""

from __future__ import annotations

from dataclasses import dataclass

# Codes of diagnostics.
CODES = {
    "E_CHAR": "a character that starts no token",
    "E_STRING": "a string without an end, or an unknown escape",
    "E_SYNTAX": "something else is expected here",
    "E_CHAIN": "comparisons do not chain",
    "E_NAME": "an unknown name",
    "E_TYPE": "a type that does not fit",
    "E_ARGS": "a function with wrong arguments",
    "E_CYCLE": "definitions that refer to each other",
    "R_FIELD": "an unknown or missing field",
    "R_KIND": "a stat needs exactly one kind",
    "R_VALUE": "a value that is not allowed",
    "R_ID": "an id that is taken",
    "R_REF": "a reference that leads nowhere",
    "R_SCOPE": "something that this scope may not read",
}


@dataclass(frozen=True)
class Diagnostic:
    code: str
    message: str
    at: int = 0
    where: str = ""

    def __str__(self) -> str:
        place = f"{self.where}: " if self.where else ""
        return f"{place}{self.code} at {self.at}: {self.message}"


class RuleError(ValueError):
    """One or more diagnostics."""

    def __init__(self, *found: Diagnostic):
        super().__init__("\n".join(map(str, found)))
        self.found = list(found)

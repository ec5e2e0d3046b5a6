"""What a request can be refused with.  A refusal names the thing asked or the bound, never data."""

from __future__ import annotations


class Refused(Exception):
    """Base of all refusals."""


class InvalidArgument(Refused):
    def __init__(self, name: str, detail: str):
        super().__init__(f"argument {name} refused: {detail}")
        self.name = name


class Denied(Refused):
    """The capability lacks a grant."""


class OverBudget(Refused):
    """A bound would be exceeded; nothing is cut short."""


class Timeout(Refused):
    """The time budget ran out; the Spark jobs were cancelled and nothing was applied."""

"""Errors of the engine."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all errors."""


class NotFound(EngineError):
    """A key or file doesn't exist."""


class ReadOnly(EngineError):
    """A write to something opened for reading."""


class Closed(EngineError):
    """Use after closing."""


class Released(EngineError):
    """Use of a released iterator or version."""


class Corrupted(EngineError):
    """Stored bytes that can't be right; ``where`` names the file or field."""

    def __init__(self, reason: str, where: str | None = None):
        self.reason, self.where = reason, where
        super().__init__(f"{where}: {reason}" if where else reason)


class InvalidKey(EngineError):
    """An internal key of a wrong length or kind."""

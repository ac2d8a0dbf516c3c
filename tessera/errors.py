"""Errors by kind."""


class EngineError(Exception):
    """Any error of this engine."""


class InvalidError(EngineError):
    """An argument or plan that makes no sense."""


class NotSupportedError(EngineError):
    """A known name without an implementation, or an unknown name."""


class NotFoundError(EngineError):
    """A table that doesn't exist."""


class CorruptError(EngineError):
    """Stored data that fails verification."""

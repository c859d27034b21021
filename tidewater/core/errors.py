"""Errors of the engine. Each also derives from the built-in a caller would expect."""


class TidewaterError(Exception):
    """Root of all errors raised here."""


class NotFittedError(TidewaterError):
    """A step was applied before it had learned its state."""


class ColumnNotFoundError(TidewaterError, KeyError):
    """A named column is not in the frame."""

    def __str__(self) -> str:
        return str(self.args[0]) if self.args else ""


class SchemaError(TidewaterError, ValueError):
    """The frame's shape or types do not suit the operation."""


class ConfigurationError(TidewaterError, ValueError):
    """A parameter is unknown, missing or out of range."""


class MissingDependencyError(TidewaterError, ImportError):
    """An optional package is needed and absent."""


class ExtractionError(TidewaterError):
    """An archive or download could not be used."""


class CredentialsError(ExtractionError):
    """No usable credentials for a remote service."""

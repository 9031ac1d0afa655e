"""Errors that a single conversion raises; corpora carry them in the ``error`` column instead."""


class FoliantError(Exception):
    """Base of all errors of this package."""


class UnsupportedFormatError(FoliantError):
    """The input is neither PDF nor DOCX."""


class PasswordRequiredError(FoliantError):
    """The file is encrypted and the password doesn't open it."""


class ParseError(FoliantError):
    """The file can't be read."""


class MissingBackendError(FoliantError):
    """A package that a format needs is missing where the work runs."""

    def __init__(self, package: str, format: str):
        self.package, self.format = package, format
        super().__init__(f"{format.upper()} files need the package {package!r}: pip install {package}")


def error_of(message: str) -> FoliantError:
    """The error that a row's ``error`` tells of."""
    kind, _, rest = message.partition(": ")
    known = {"PasswordRequired": PasswordRequiredError, "UnsupportedFormatError": UnsupportedFormatError}
    return known.get(kind, ParseError)(rest or message)

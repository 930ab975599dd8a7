"""What can go wrong, by kind."""


class QuernError(Exception):
    """Any error of this package."""


class ParseError(QuernError):
    """A command that is not well-formed."""


class UnknownName(QuernError):
    """A database, table, column or handle that does not exist."""


class DuplicateName(QuernError):
    """A table or column that exists already."""


class TypeMismatch(QuernError):
    """A handle of the wrong kind."""


class LengthMismatch(QuernError):
    """Vectors or selections of different length that should match."""


class BatchError(QuernError):
    """A command that a batch does not take, or a batch begun or run out of order."""

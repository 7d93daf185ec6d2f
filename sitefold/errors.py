"""What an analysis raises instead of giving a result."""


class BadInput(ValueError):
    """Arguments or data that an analysis cannot work with."""


class PolicyViolation(PermissionError):
    """A site has too few rows or values to share anything."""


class ColumnNotAllowed(PermissionError):
    """A site does not share this column."""

"""The one error that reading, parsing and validating raise."""


class ScanError(Exception):
    """A source that can't be read as asked, a malformed record, or a query that names what isn't there."""

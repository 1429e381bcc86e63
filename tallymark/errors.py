"""The one exception of this package."""

#: fixed values: status names
STATUSES = ("OK", "OUT_OF_MEMORY", "IO_ERROR", "TOO_LARGE", "UNTERMINATED_QUOTE", "RAGGED_ROW", "DUPLICATE_KEY", "COLUMN_ORDER", "NO_HEADER", "MISSING_KEY_COLUMN", "BAD_CONTENT", "INVALID_ARG", "UNIMPLEMENTED")


class ReconcileError(Exception):
    """Stops a comparison; ``status`` is one of STATUSES. Findings about values are output, never exceptions."""

    def __init__(self, status: str, message: str):
        if status not in STATUSES:
            raise ValueError(status)
        super().__init__(f"{status}: {message}")
        self.status, self.message = status, message

    def __reduce__(self):
        return type(self), (self.status, self.message)

"""Errors of the search engine, each with the code by which clients know it."""


class QueryError(ValueError):
    """A query that can't be understood; the message says why."""

    code = "invalidQuery"


class NotReady(RuntimeError):
    """No snapshot has been published yet."""

    code = "indexNotReady"


class Denied(PermissionError):
    """The scope may not be read."""

    code = "permissionDenied"


class Busy(RuntimeError):
    """Too many requests at once."""

    code = "overloaded"


class Cancelled(RuntimeError):
    """The request was cancelled or replaced by a later one."""

    code = "cancelled"


class Failed(RuntimeError):
    """Something went wrong within; the cause is attached."""

    code = "internalError"


class Unavailable(RuntimeError):
    """The engine doesn't answer."""

    code = "serviceUnavailable"


def code_of(error: BaseException) -> str:
    """The code of any error."""
    return getattr(error, "code", Failed.code) if isinstance(error, (QueryError, NotReady, Denied, Busy, Cancelled, Failed, Unavailable)) else Failed.code

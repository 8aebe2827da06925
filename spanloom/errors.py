"""What can go wrong, by kind. ``FATAL`` errors stop a run even where single units may fail."""

from __future__ import annotations


class SpanloomError(Exception):
    """Base of all errors of this package."""


class ConfigurationError(SpanloomError):
    """A missing key or a bad option."""


class BudgetExceededError(SpanloomError):
    """The next request would cost more than is left."""


class ResponseValidationError(SpanloomError):
    """An answer that does not fit its question."""


class ExtractionError(SpanloomError):
    """A unit failed and the policy is to raise; ``errors`` holds what failed, ``result`` the tables of what did not."""

    def __init__(self, message: str, errors: list | None = None, result: object = None):
        super().__init__(message)
        self.errors, self.result = errors or [], result


class SchemaError(SpanloomError, ValueError):
    """A schema that contradicts itself."""


class APIError(SpanloomError):
    """A failed request. ``retryable`` tells whether trying again can help."""

    retryable = False

    def __init__(self, message: str, status: int | None = None, retry_after: float | None = None):
        super().__init__(f"{status} {message}" if status else message)
        self.status, self.retry_after = status, retry_after


class AuthenticationError(APIError):
    pass


class RequestTooLargeError(APIError):
    """``limit_kind`` is 'questions', 'tokens' or None, ``limit`` the number that the server named."""

    limit_kind: str | None = None
    limit: int | None = None


class InvalidRequestError(APIError):
    pass


class RateLimitError(APIError):
    retryable = True


class ServerError(APIError):
    retryable = True


class TransportError(APIError):
    retryable = True


FATAL = (AuthenticationError, BudgetExceededError, ConfigurationError)

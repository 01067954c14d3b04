"""Errors that callers of the history service can tell apart."""


class HistoryError(Exception):
    """Base of all errors of this package."""


class NotFound(HistoryError): ...
class CasConflict(HistoryError): ...
class PublicationConflict(HistoryError): ...
class ReadOnlyMode(HistoryError): ...
class LeaseStillFresh(HistoryError): ...
class LeaseObservationUnavailable(HistoryError): ...
class LeaseLost(HistoryError): ...
class InvalidSequence(HistoryError): ...
class InvalidParent(HistoryError): ...
class FinalityViolation(HistoryError): ...
class InvalidParams(HistoryError): ...
class DecodeError(HistoryError): ...
class BackendError(HistoryError): ...
class Unsupported(HistoryError): ...


class QueryTooBroad(HistoryError):
    def __init__(self, actual: int, maximum: int):
        super().__init__(f"a clause has {actual} alternatives; at most {maximum} are planned")
        self.actual, self.maximum = actual, maximum

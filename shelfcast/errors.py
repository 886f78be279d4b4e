"""Errors of the engine."""


class FreshRetailDomainError(Exception):
    """Input that breaks the contract of the daily source."""


class UnpinnedRevisionError(FreshRetailDomainError):
    pass


class NonPinnedRevisionError(FreshRetailDomainError):
    pass


class InvalidStreamLimitError(FreshRetailDomainError):
    pass


class RowValidationError(FreshRetailDomainError):
    pass


class HourlyVectorLengthError(RowValidationError):
    pass


class StockStatusValueError(RowValidationError):
    pass


class StockCounterError(RowValidationError):
    pass


class DailySumMismatchError(RowValidationError):
    pass


class GlobalSnapshotError(FreshRetailDomainError):
    pass


class DuplicateKeyError(ValueError):
    pass


class SplittingError(ValueError):
    pass


class InvalidBoundaryOrderError(SplittingError):
    pass


class BaselineError(Exception):
    pass


class TargetNotInFutureError(BaselineError):
    pass


class BenchmarkReportError(RuntimeError):
    pass


ROW_ERRORS = {c.__name__: c for c in (RowValidationError, HourlyVectorLengthError, StockStatusValueError, StockCounterError, DailySumMismatchError)}

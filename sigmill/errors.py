"""Failures that callers may want to tell apart. Operators fail closed: they raise rather than drop or truncate."""


class AnalysisError(ValueError):
    """Base of all failures of this package."""


class HeaderCollision(AnalysisError):
    """Two header names are equal after normalisation."""


class MissingColumns(AnalysisError):
    """A required column is absent."""


class InvalidIdentifier(AnalysisError):
    """An identifier is no positive decimal number."""


class IntegrityError(AnalysisError):
    """Parents aren't unique, a child has no parent, or a child disagrees with it."""


class UnsupportedRole(AnalysisError):
    """A role code is outside the known ones."""


class JoinBudgetExceeded(AnalysisError):
    """A report would yield more pairs than the budget allows."""


class PopulationError(AnalysisError):
    """A population is not contained in the one it should be part of."""


class InvalidTable(AnalysisError):
    """A 2x2 table is negative, inconsistent with its margins, or too large to be exact."""


class UnsafeText(AnalysisError):
    """A text would be read as a formula by a spreadsheet."""


class InvalidRegister(AnalysisError):
    """A source register row is malformed."""


class ArchiveRejected(AnalysisError):
    """An archive breaks a safety rule or budget."""


class InvalidManifest(AnalysisError):
    """A dataset manifest is malformed."""


class InvalidProtocol(AnalysisError):
    """An analysis request is malformed or outside the data set."""


class DatasetNotFound(AnalysisError):
    """No data set of that id is registered."""


class NoMatchingRows(AnalysisError):
    """The protocol selects nothing."""


class BatchMethodRequired(AnalysisError):
    """The protocol asks for a method that is not computed on request."""


class ResultTooLarge(AnalysisError):
    """The protocol selects more rows than a bounded result may have."""


class ImmutableConflict(AnalysisError):
    """A stored result exists under the id with other content."""

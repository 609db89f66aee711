"""Typed errors; what a caller may retry is a separate class from what it may not."""


class LakeError(Exception):
    """Base of all errors of the table engine."""


class NotFound(LakeError):
    pass


class AlreadyExists(LakeError):
    pass


class NotEmpty(LakeError):
    pass


class Invalid(LakeError):
    """The request can never succeed as it stands."""


class Unsupported(Invalid):
    """Refused by name, with the reason."""


class CommitConflict(LakeError):
    """Another commit touched the same rows; read again and retry."""


class DdlSinceReadSnapshot(LakeError):
    """The table's definition changed since the read; retrying the same bytes cannot help."""


class IncarnationChanged(LakeError):
    """The table was dropped and made anew."""


class Expired(LakeError):
    """The snapshot is below the retention floor."""


class ReconciliationRequired(LakeError):
    """A window of changes crosses a truncation or replacement."""


class OffsetRegression(LakeError):
    pass


class CorruptDeletionVector(LakeError):
    pass


class CoercionError(LakeError):
    def __init__(self, reason: str):
        super().__init__(reason)
        self.reason = reason

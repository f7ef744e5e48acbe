"""What can go wrong, with the codes that callers and quarantine tables see."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Code and status of each kind of error.
STATUS = {
    "VALIDATION_ERROR": 400, "UPLOAD_TOO_LARGE": 413, "UNSUPPORTED_MEDIA_TYPE": 415, "IDENTITY_RESOLUTION_ERROR": 422, "MERGE_CONFLICT": 409, "PROJECTION_ERROR": 500, "PIPELINE_ERROR": 500,
}


class FusionError(Exception):
    """An error with a code and the status that belongs to it."""

    code = "PIPELINE_ERROR"

    def __init__(self, message: str, **details):
        super().__init__(message)
        self.details = details

    @property
    def status(self) -> int:
        return STATUS[self.code]


class ExtractionError(FusionError):
    """A source cannot be read; strict runs end with it, others put the source aside."""


class ConfigurationError(FusionError):
    code = "VALIDATION_ERROR"


class IdentityError(FusionError):
    code = "IDENTITY_RESOLUTION_ERROR"


class MergeConflictError(FusionError):
    code = "MERGE_CONFLICT"


class UploadError(FusionError):
    code = "UNSUPPORTED_MEDIA_TYPE"


def quarantine_code(reason: Column) -> Column:
    """The code of a source's reject reason; null for none."""
    return F.when(reason == "too large", "UPLOAD_TOO_LARGE").when(reason.isin("hidden extension", "missing extension", "unsupported source", "type not allowed"), "UNSUPPORTED_MEDIA_TYPE").when(reason.isNotNull(), "PIPELINE_ERROR")

"""Errors with stable codes. A document's error carries its path, so that the first by path can be raised."""

from __future__ import annotations


class ProjectError(Exception):
    code = "PROJECT_ERROR"


class ConfigError(ProjectError):
    code = "CONFIG_ERROR"


class DocumentError(ProjectError):
    code = "DOCUMENT_ERROR"

    def __init__(self, message: str, path: str | None = None):
        super().__init__(message)
        self.path = path


class UnreadableDocument(DocumentError):
    code = "UNREADABLE_DOC"


class FrontmatterError(DocumentError):
    code = "FRONTMATTER_ERROR"


class DuplicateId(ProjectError):
    code = "DUPLICATE_ID"


class BrokenRef(ProjectError):
    code = "BROKEN_REF"


class ValidationError(ProjectError):
    code = "VALIDATION_ERROR"


class TicketError(ProjectError):
    code = "TICKET_ERROR"


class ConflictError(ProjectError):
    code = "RECONCILE_CONFLICT"


class PersistenceError(ProjectError):
    code = "RECONCILE_PERSISTENCE"


class WarningAsError(ProjectError):
    code = "WARNING_AS_ERROR"


BY_CODE = {c.code: c for c in (UnreadableDocument, FrontmatterError)}

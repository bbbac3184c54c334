"""Typed errors, by what went wrong."""


class EngineError(Exception):
    """Base of all errors of this engine."""


class KeyNotFound(EngineError): ...
class KeyExists(EngineError): ...
class SchemaValidation(EngineError): ...
class InvalidOperation(EngineError): ...
class RelationshipViolation(EngineError): ...
class ConflictError(EngineError): ...
class AttachmentError(EngineError): ...
class MigrationError(EngineError): ...
class UpgradeRequired(EngineError): ...
class TransactionAborted(EngineError): ...
class SnapshotExpired(EngineError): ...
class CommitConflict(EngineError): ...
class ReadOnly(EngineError): ...
class AlreadyOpen(EngineError): ...
class LimitExceeded(EngineError): ...
class StorageError(EngineError): ...

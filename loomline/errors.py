"""Errors of jobs, clients, messages, normalisation and warm-up, each with its fixed text."""

from __future__ import annotations


class JobError(Exception):
    """Base of all errors that jobs raise; text takes the error's one part."""

    text = "{}"

    def __init__(self, part: object = ""):
        self.part = part
        super().__init__(self.text.format(part))


# The texts of the fourteen errors of jobs.


class GraphNotFound(JobError):
    text = "Graph not found: {}"


class ExecutionFailed(JobError):
    text = "Execution failed: {}"


class FunctionError(JobError):
    """A batch function is unknown or none."""

    text = "Wasm runtime error: {}"


class DataPlaneError(JobError):
    text = "Data plane error: {}"


class SerializationError(JobError):
    text = "Serialization error: {}"


class StorageError(JobError):
    text = "IO error: {}"


class ParquetError(JobError):
    text = "Parquet error: {}"


class ArrowError(JobError):
    text = "Arrow error: {}"


class InvalidState(JobError):
    text = "Graph not in valid state for operation: {}"


class QuotaExceeded(JobError):
    text = "Resource quota exceeded: {}"


class AuthenticationRequired(JobError):
    text = "Authentication required"


class AuthorizationFailed(JobError):
    text = "Authorization failed: {}"


class IdempotencyKeyExists(JobError):
    text = "Idempotency key already exists: {}"


class ProtocolVersionMismatch(JobError):
    text = "Protocol version mismatch: expected {}, got {}"

    def __init__(self, expected: str, got: str):
        self.expected, self.got = expected, got
        Exception.__init__(self, self.text.format(expected, got))


class SchemaError(DataPlaneError):
    """A source's columns are not those declared."""


class UnknownTenant(AuthorizationFailed):
    def __init__(self, tenant: str):
        super().__init__(f"Tenant not found: {tenant}")


class ClientError(Exception):
    """Base of what a client raises."""


class RequestFailed(ClientError):
    def __init__(self, part: object):
        super().__init__(f"Request failed: {part}")


class ServerError(ClientError):
    def __init__(self, part: object):
        super().__init__(f"Server error: {part}")


class ClientGraphNotFound(ClientError):
    def __init__(self, graph_id: str):
        super().__init__(f"Graph not found: {graph_id}")


class ClientAuthenticationRequired(ClientError):
    def __init__(self) -> None:
        super().__init__("Authentication required")


class ProtocolError(Exception):
    """Base of what a message may be refused for."""


class VersionMismatch(ProtocolError):
    def __init__(self, expected: str, got: str):
        super().__init__(f"Protocol version mismatch: expected one of {expected}, got {got}")


class InvalidMessage(ProtocolError):
    def __init__(self, part: object):
        super().__init__(f"Invalid message: {part}")


class MessageSerialization(ProtocolError):
    def __init__(self, part: object):
        super().__init__(f"Serialization error: {part}")


class UnsupportedMessageType(ProtocolError):
    def __init__(self, kind: object):
        super().__init__(f"Unsupported message type: {kind}")


#: What errors of data say, which columns carry instead of exceptions.
ZERO_VOLUME = "Volume total é zero, normalização impossível"
OVERFLOW = "Overflow: valor {} excede u32::MAX"
UNDERFLOW = "Underflow: valor {} é muito pequeno"
WARMUP_TIMEOUT = "Warm-up excedeu timeout de {}ms"
WARMUP_FAILED = "Falha na convergência durante warm-up"

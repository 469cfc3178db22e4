"""What the engine raises."""

from __future__ import annotations


class StorageError(Exception):
    """Anything that goes wrong in a store and has no name of its own."""


class CollectionAlreadyExists(StorageError):
    pass


class CollectionNotFound(StorageError):
    pass


class IndexAlreadyExists(StorageError):
    pass


class IndexNotFound(StorageError):
    pass


class CodecFailure(StorageError):
    """A key or value that cannot be decoded, or a schema that does not fit."""


class OverSizedKey(StorageError):
    """A key whose bytes exceed the store's limit."""


class NestedWriteTransaction(StorageError):
    """A write inside an open write transaction of the same thread."""


class WriteConflict(StorageError):
    """Another writer committed first."""


class KeyCodecError(CodecFailure):
    """``kind`` is one of invalid_input, insufficient_bytes, unexpected_byte, unescaped_zero, missing_separator, internal."""

    def __init__(self, kind: str, message: str = "") -> None:
        super().__init__(f"{kind}: {message}" if message else kind)
        self.kind = kind

"""The errors of the engine; `code` is what the JSON interface reports. The codes and the messages."""

from __future__ import annotations


class EngineError(Exception):
    code = "io_error"


class SchemaError(EngineError):
    code = "schema_error"


class InvalidWorkspaceName(SchemaError):
    def __init__(self, name: str):
        super().__init__(f"invalid workspace name `{name}`; use letters, digits, `-`, or `_`")


class InvalidTableName(SchemaError):
    def __init__(self, name: str):
        super().__init__(f"invalid table name `{name}`; use lowercase snake_case")


class ReservedFieldName(SchemaError):
    def __init__(self, field: str):
        super().__init__(f"field name is reserved for internal storage metadata: {field}")


class InvalidFieldName(SchemaError):
    def __init__(self, field: str):
        super().__init__(f"invalid field name: {field}")


class UnknownTable(SchemaError):
    code = "unknown_table"

    def __init__(self, table: str):
        super().__init__(f"unknown table: {table}")


class UnknownField(SchemaError):
    code = "unknown_field"

    def __init__(self, table: str, field: str):
        super().__init__(f"table `{table}` has no field `{field}`")


class TypeMismatch(SchemaError):
    code = "type_mismatch"

    def __init__(self, table: str, field: str, expected: str, found: str):
        super().__init__(f"table `{table}` field `{field}` type mismatch: expected {expected}, found {found}")


class DuplicateField(SchemaError):
    def __init__(self, table: str, field: str):
        super().__init__(f"table `{table}` already defines field `{field}`")


class DuplicateLookup(SchemaError):
    def __init__(self, table: str, field: str):
        super().__init__(f"table `{table}` already defines lookup `{field}`")


class DuplicateTable(SchemaError):
    def __init__(self, table: str):
        super().__init__(f"table `{table}` already exists")


class MissingIdField(SchemaError):
    def __init__(self, table: str):
        super().__init__(f"table `{table}` must include an `id` field")


class IdFieldMustBeId(SchemaError):
    def __init__(self, table: str):
        super().__init__(f"table `{table}` field `id` must use primitive type `id`")


class UnknownLookupField(SchemaError):
    def __init__(self, table: str, field: str):
        super().__init__(f"table `{table}` lookup `{field}` has no field")


class MissingField(SchemaError):
    def __init__(self, table: str, field: str):
        super().__init__(f"table `{table}` is missing required field `{field}`")


class SchemaSyntaxError(SchemaError):
    """In the schema language; line and column are 1-based, or 0 for rules on the whole."""

    def __init__(self, message: str, line: int = 0, column: int = 0):
        super().__init__(f"{line}:{column}: {message}")
        self.line, self.column = line, column


class SchemaMismatch(SchemaError):
    code = "schema_mismatch"


class PlanError(EngineError):
    code = "invalid_plan"


class InvalidPlan(PlanError):
    pass


class UnknownLookup(InvalidPlan):
    code = "unknown_lookup"


class NotFound(PlanError):
    code = "not_found"


class InvalidValue(EngineError):
    code = "invalid_value"


class AlreadyExists(EngineError):
    code = "already_exists"


class InvalidInput(EngineError):
    code = "io_error"


class CorruptData(EngineError):
    code = "io_error"


class CommitConflict(EngineError):
    """Another writer published the version first; the batch is resolved anew."""


class FormatError(CorruptData):
    """Of the text log, its lines and its index."""


class UnsupportedVersion(FormatError):
    def __init__(self, expected: int, found: int):
        super().__init__(f"unsupported format version: expected {expected}, found {found}")


class BadColumnCount(FormatError):
    def __init__(self, expected: int, found: int):
        super().__init__(f".6 row column count mismatch: expected {expected}, found {found}")


class BadMagic(FormatError):
    def __init__(self, line: str):
        super().__init__(f".6 file has bad magic: {line}")


class BadTx(FormatError):
    def __init__(self, reason: str):
        super().__init__(f".6 row has invalid tx id: {reason}")


class BadOperation(FormatError):
    def __init__(self, operation: str):
        super().__init__(f".6 row has invalid operation: {operation}")


class BadValue(FormatError):
    def __init__(self, field: str, kind: str, value: str):
        super().__init__(f".6 field `{field}` expected {kind}, got `{value}`")


class BadEscape(FormatError):
    def __init__(self, value: str):
        super().__init__(f".6 value has bad escape: {value}")


class BadRecord(FormatError):
    def __init__(self, reason: str):
        super().__init__(f".6 record error: {reason}")


class BadIndex(FormatError):
    def __init__(self, reason: str):
        super().__init__(f".6b cache error: {reason}")


class DecodeError(FormatError):
    """Of an old JSON log."""

    def __init__(self, reason: str):
        super().__init__(f"decode error: {reason}")


class ClientError(EngineError):
    """What a client of the JSON interface meets; the code is its own."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code

"""Tables of five non-null scalar kinds with declared lookups, and the language that declares them."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import types as T

from . import errors as E

# The kinds and the Spark types that hold them.
KINDS: dict[str, T.DataType] = {"id": T.StringType(), "text": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType()}
NAME = re.compile(r"[a-z][a-z0-9_]*")
WORKSPACE = re.compile(r"[A-Za-z0-9_-]+")


def check_table_name(name: str) -> str:
    if not NAME.fullmatch(name) or "__" in name:
        raise E.InvalidTableName(name)
    return name


def check_field_name(name: str) -> str:
    if name.startswith("_"):
        raise E.ReservedFieldName(name)
    if not NAME.fullmatch(name) or "__" in name:
        raise E.InvalidFieldName(name or "<empty>")
    return name


def check_workspace(name: str) -> str:
    if not WORKSPACE.fullmatch(name) or name.startswith("_"):
        raise E.InvalidWorkspaceName(name)
    return name


def fnv1a(parts: Iterable[bytes]) -> str:
    """FNV-1a of 64 bits as 16 hex digits."""
    h = 0xCBF29CE484222325
    for part in parts:
        for byte in part:
            h = (h ^ byte) * 0x100000001B3 % 2**64
    return f"{h:016x}"


@dataclass
class TableSchema:
    """Fields keep their declared order; `id` is always a unique lookup, the others are added."""

    name: str
    fields: dict[str, str] = field(default_factory=dict)
    lookups: dict[str, bool] = field(default_factory=dict)  # name -> unique

    @classmethod
    def of(cls, name: str, fields: dict[str, str], lookups: Iterable[str] = (), unique: Iterable[str] = ()) -> TableSchema:
        """A checked table. `id` need not be among the fields."""
        table = cls(check_table_name(name))
        for f, kind in ({"id": "id"} | fields).items():
            table.add_field(f, kind)
        for f in lookups:
            table.add_lookup(f, False)
        for f in unique:
            table.add_lookup(f, True)
        table.check()
        return table

    def add_field(self, name: str, kind: str) -> None:
        check_field_name(name)
        if kind not in KINDS:
            raise E.SchemaError(f"unknown field type: {kind}")
        if name in self.fields:
            raise E.DuplicateField(self.name, name)
        self.fields[name] = kind

    def add_lookup(self, name: str, unique: bool) -> None:
        if name in self.lookups:
            raise E.DuplicateLookup(self.name, name)
        self.lookups[name] = unique

    def check(self) -> None:
        check_table_name(self.name)
        if "id" not in self.fields:
            raise E.MissingIdField(self.name)
        if self.fields["id"] != "id":
            raise E.IdFieldMustBeId(self.name)
        for f in self.lookups:
            if f not in self.fields:
                raise E.UnknownLookupField(self.name, f)

    def is_lookup(self, name: str) -> bool:
        return name == "id" or name in self.lookups

    def is_unique(self, name: str) -> bool:
        return name == "id" or self.lookups.get(name, False)

    @property
    def unique_lookups(self) -> list[str]:
        return [f for f, unique in self.lookups.items() if unique and f != "id"]

    def struct(self, nullable: bool = False) -> T.StructType:
        return T.StructType([T.StructField(f, KINDS[k], nullable, {"kind": k}) for f, k in self.fields.items()])

    def signature(self, ordered: bool = True) -> str:
        """ordered: lookups by name, as tables are stored; else as declared."""
        others = [f for f in self.lookups if f != "id"]
        looks = ["lookup:id:unique"] + [f"lookup:{f}:{'unique' if self.lookups[f] else 'many'}" for f in (sorted(others) if ordered else others)]
        return "|".join([self.name, *(f"{f}:{k}" for f, k in self.fields.items()), *looks])

    def check_row(self, row: dict[str, object]) -> None:
        """Presence in declared order, then names and kinds in the names' order. Nothing is converted."""
        if "id" not in row:
            raise E.MissingField(self.name, "id")
        for f in self.fields:
            if f not in row:
                raise E.MissingField(self.name, f)
        for f in sorted(row):
            self.check_value(f, row[f])

    def check_value(self, f: str, value: object) -> None:
        if f not in self.fields:
            raise E.UnknownField(self.name, f)
        want, kind = self.fields[f], kind_of(value)
        if not (kind == want or kind == "text" and want == "id"):
            raise E.TypeMismatch(self.name, f, want, kind)


class Id(str):
    """A string that is an identifier. Plain strings are taken for either kind; an Id is no text."""

    __slots__ = ()


def kind_of(value: object) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int" if -(2**63) <= value < 2**63 else "big integer"
    if isinstance(value, float):
        return "float"
    if isinstance(value, Id):
        return "id"
    return "text" if isinstance(value, str) else type(value).__name__


@dataclass
class DatabaseSchema:
    tables: dict[str, TableSchema] = field(default_factory=dict)

    @classmethod
    def of(cls, *tables: TableSchema) -> DatabaseSchema:
        out = cls()
        for t in tables:
            out.add(t)
        return out

    def add(self, table: TableSchema) -> None:
        table.check()
        if table.name in self.tables:
            raise E.DuplicateTable(table.name)
        self.tables[table.name] = table

    def table(self, name: str) -> TableSchema:
        if name not in self.tables:
            raise E.UnknownTable(name)
        return self.tables[name]

    def stored_hash(self) -> str:
        """Tables and lookups in the order of their names."""
        return fnv1a(f"{self.tables[n].signature()}\n".encode() for n in sorted(self.tables))

    def declared_hash(self) -> str:
        """Tables and lookups in the order in which they were declared; clients compare this one."""
        return fnv1a(f"{t.signature(ordered=False)}\n".encode() for t in self.tables.values())


TOKEN = re.compile(r"(?P<space>[ \t\r\n]+)|(?P<comment>//[^\n]*)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<mark>[{}!;])")


def parse_schema(text: str) -> DatabaseSchema:
    """`schema! { table { field kind ... lookup field [unique] ... } ... }`; bare table blocks will do as well.
    Semicolons are optional, `//` starts a comment; nothing may follow the closing brace."""
    tokens: list[tuple[str, int, int]] = []
    at, line, start = 0, 1, 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise E.SchemaSyntaxError(f"unexpected character {text[at]!r}", line, at - start + 1)
        if m.lastgroup in ("name", "mark"):
            tokens.append((m[0], line, at - start + 1))
        if "\n" in m[0]:
            line += m[0].count("\n")
            start = at + m[0].rindex("\n") + 1
        at = m.end()
    tokens.append(("", line, len(text) - start + 1))
    place = 0

    def take(*wanted: str) -> str:
        nonlocal place
        value, ln, col = tokens[place]
        ok = value in wanted if wanted else bool(value) and (value[0].isalpha() or value[0] == "_")
        if not ok:
            raise E.SchemaSyntaxError(f"expected {' or '.join(wanted) or 'a name'}, found {value or 'the end'}", ln, col)
        place += 1
        return value

    wrapped = tokens[0][0] == "schema" and tokens[1][0] == "!"
    if wrapped:
        place = 2
        take("{")
    out = DatabaseSchema()
    while tokens[place][0] not in ("}", "") if wrapped else tokens[place][0]:
        name = take()
        if not NAME.fullmatch(name) or "__" in name:
            raise E.SchemaSyntaxError(f"invalid table name: {name}")
        table = TableSchema(name)
        take("{")
        while tokens[place][0] != "}":
            word = take()
            if word == "lookup":
                f = take()
                unique = tokens[place][0] == "unique"
                place += unique
                try:
                    table.add_lookup(f, unique)
                except E.DuplicateLookup:
                    raise E.SchemaSyntaxError(f"duplicate lookup on '{f}' in table '{name}'") from None
            else:
                kind, ln, col = tokens[place]
                take()
                if kind not in KINDS:
                    raise E.SchemaSyntaxError(f"unknown field type: {kind}", ln, col)
                try:
                    table.add_field(word, kind)
                except E.ReservedFieldName:
                    raise E.SchemaSyntaxError(f"field name cannot start with '_': {word}") from None
                except E.InvalidFieldName:
                    raise E.SchemaSyntaxError(f"invalid field name: {word}") from None
                except E.DuplicateField:
                    raise E.SchemaSyntaxError(f"duplicate field in table {name}: {word}") from None
            if tokens[place][0] == ";":
                place += 1
        take("}")
        if "id" not in table.fields:
            raise E.SchemaSyntaxError(f"table '{name}' is missing required field 'id'")
        for f in table.lookups:
            if f not in table.fields:
                raise E.SchemaSyntaxError(f"lookup '{f}' refers to missing field '{f}' in table '{name}'")
        if name in out.tables:
            raise E.SchemaSyntaxError(f"duplicate table name: {name}")
        out.add(table)
    if wrapped:
        take("}")
    if tokens[place][0]:
        raise E.SchemaSyntaxError(f"unexpected {tokens[place][0]} after the schema", *tokens[place][1:])
    return out


def stub(schema: DatabaseSchema) -> str:
    """Typed Python stubs of the tables' rows, for editors."""
    kinds = {"id": "str", "text": "str", "int": "int", "float": "float", "bool": "bool"}
    out = ["from typing import TypedDict", ""]
    for t in schema.tables.values():
        name = "".join(p.capitalize() for p in t.name.split("_"))
        out += ["", f"class {name}(TypedDict):", *(f"    {f}: {kinds[k]}" for f, k in t.fields.items()), ""]
    return "\n".join(out)

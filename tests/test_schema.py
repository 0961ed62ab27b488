from __future__ import annotations

import pytest

from logloom import errors as E
from logloom.schema import DatabaseSchema, Id, TableSchema, check_workspace, parse_schema, stub

CHAT = """
schema! {
    // people
    users { id id name text email text is_ai_user bool lookup email unique }
    conversations { id id; owner_id id; title text; created_at int; lookup owner_id; lookup created_at }
    messages {
        id id
        conversation_id id
        sender_id id
        body text
        created_at int
        lookup conversation_id
        lookup created_at
    }
}
"""


def test_hashes_of_the_chat_schema():
    schema = parse_schema(CHAT)
    assert schema.declared_hash() == "0998dc171e3b836c"
    assert schema.stored_hash() == "db462299275c1e10"


def test_bare_tables_and_order():
    schema = parse_schema("a { id id z text b int }")
    assert list(schema.table("a").fields) == ["id", "z", "b"]
    assert [f.nullable for f in schema.table("a").struct()] == [False] * 3
    assert "z: str" in stub(schema)


@pytest.mark.parametrize(
    "text",
    ["schema! { a { id id } } x", "a { id id b blob }", "a { b text }", "A { id id }", "a { id id lookup c }", "a { id id b int b int }", "a { id id } a { id id }", "a { id id _b text }", "a { id id b text lookup b lookup b }", "a { id id", "schema! { a { id id }", "a { id id # }", "a__b { id id }"],
)
def test_bad_schemas(text):
    with pytest.raises(E.SchemaSyntaxError):
        parse_schema(text)


def test_place_of_an_error():
    with pytest.raises(E.SchemaSyntaxError) as e:
        parse_schema("a {\n  id id\n  b blob\n}")
    assert (e.value.line, e.value.column) == (3, 5)


def test_id_kind_and_names():
    with pytest.raises(E.IdFieldMustBeId):
        parse_schema("a { id text }")
    with pytest.raises(E.InvalidTableName):
        TableSchema.of("Bad", {})
    with pytest.raises(E.ReservedFieldName):
        TableSchema.of("t", {"_x": "int"})
    with pytest.raises(E.UnknownLookupField):
        TableSchema.of("t", {"x": "int"}, ["y"])
    with pytest.raises(E.DuplicateTable):
        DatabaseSchema.of(TableSchema.of("t", {}), TableSchema.of("t", {}))
    for name in ("", ".", "..", "_x", "a b", "a/b"):
        with pytest.raises(E.InvalidWorkspaceName):
            check_workspace(name)
    assert check_workspace("My-ws_1")


def test_rows_are_checked_in_order():
    t = TableSchema.of("t", {"b": "int", "a": "text", "c": "id"})
    good = {"id": "1", "b": 2, "a": "x", "c": Id("y")}
    t.check_row(good)
    for row, error in (({"b": 1}, E.MissingField), ({"id": "1", "b": 1}, E.MissingField), (good | {"z": 1}, E.UnknownField), (good | {"b": "2"}, E.TypeMismatch), (good | {"b": True}, E.TypeMismatch), (good | {"a": Id("x")}, E.TypeMismatch), (good | {"b": 2**63}, E.TypeMismatch), (good | {"a": None}, E.TypeMismatch)):
        with pytest.raises(error):
            t.check_row(row)

from __future__ import annotations

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from logloom import errors as E
from logloom.api import Database, Key, WriteBatch
from logloom.plans.request import Op, Plan, change, selector

SCHEMA = """
notes { id id notebook_id id title text body text updated_at int lookup notebook_id lookup updated_at }
users { id id email text name text lookup email unique }
all_kinds { id id email text age int score float active bool lookup email unique lookup score lookup active lookup age }
"""


@pytest.fixture
def db(spark, tmp_path):
    database = Database.open(spark, str(tmp_path), "main", SCHEMA)
    database.init()
    return database


def user(i, email=None, name="n"):
    return {"id": f"u{i}", "email": email or f"{i}@x", "name": name}


def test_pages_do_not_mix(db):
    rows = [{"id": f"m-{i:04}", "notebook_id": "c1" if i % 2 == 0 else "c2", "title": "t", "body": f"message {i}", "updated_at": i} for i in range(150)]
    out = db.insert_many("notes", rows)
    assert [r.tx_id for r in out] == list(range(1, 151))
    got, cursor = [], None
    while True:
        page = db.get_page_by("notes", "notebook_id", "c1", 17, cursor)
        got += [r["id"] for r in page]
        cursor = page.next_cursor
        if cursor is None:
            break
    assert got == [f"m-{i:04}" for i in range(0, 150, 2)]
    assert db.count("notes") == 150 and db.count("notes", "notebook_id", "c2") == 75
    assert db.get_page_by("notes", "updated_at", "42").rows[0]["id"] == "m-0042"
    assert len(db.get_many_by("notes", "notebook_id", "c1")) == 75
    assert db.scan("notes", 100).next_cursor == "100" and db.scan("notes", 100, "100").next_cursor is None
    again = Database.open(db.spark, db.options.root, "main", SCHEMA)
    assert again.count("notes") == 150 and again.get_by_id("notes", "m-0007")["body"] == "message 7"


def test_insert_twice_fails_and_changes_nothing(db):
    db.insert("users", user(1))
    before = db.store.state()
    with pytest.raises(E.AlreadyExists, match="already exists"):
        db.insert("users", user(1, "other@x"))
    assert db.count("users") == 1 and db.store.state() == before


def test_batch_rules(db):
    with pytest.raises(E.InvalidPlan, match="more than once"):
        db.insert_many("users", [user(1), user(1, "z@x")])
    with pytest.raises(E.AlreadyExists, match="multiple rows in one batch"):
        db.insert_many("users", [user(1, "same"), user(2, "same")])
    with pytest.raises(E.InvalidPlan, match="same table"):
        db.write_many([change.add("users", user(1)), change.add("notes", {})])
    with pytest.raises(E.InvalidPlan, match="cannot be mixed"):
        db.write_many([change.add("users", user(1)), change.set("users", user(2))])
    assert db.write_many([]) == [] and db.count("users") == 0


def test_unique_keys(db):
    db.insert_many("users", [user(1), user(2)])
    with pytest.raises(E.AlreadyExists, match="already used by row `u1`"):
        db.upsert("users", user(3, "1@x"))
    db.write_many([change.edit_id("users", "u1", {"email": "2@x"}), change.edit_id("users", "u2", {"email": "1@x"})])
    assert db.get_by("users", "email", "1@x")["id"] == "u2"
    db.write_many([change.remove("users", "email", "1@x"), change.set("users", user(9, "1@x"))])
    assert db.get_by("users", "email", "1@x")["id"] == "u9"


def test_patch_remove_and_replay(db):
    first = db.insert("users", user(1, name="a"))
    assert first.bytes_written == len("R\t1\tu1\t1@x\ta\n")
    assert db.patch_by_id("users", "u1", {"name": "b"}).tx_id == 2
    assert db.get_by_id("users", "u1") == user(1, name="b")
    assert db.write(change.remove("users", "email", "1@x")).operation == "delete"
    assert db.get_by_id("users", "u1") is None and db.count("users") == 0
    with pytest.raises(E.NotFound):
        db.patch_by_id("users", "u1", {"name": "c"})
    with pytest.raises(E.NotFound):
        db.write(change.remove_id("users", "u1"))
    assert db.insert("users", user(1)).tx_id == 4  # a removed id may come back
    assert db.delete_by_id("users", "none").tx_id == 5 and db.count("users") == 1
    db.apply("delete", "users", user(1))
    assert db.count("users") == 0
    for values in ({}, {"id": "x"}, {"nope": 1}):
        with pytest.raises(E.InvalidPlan):
            db.patch_by_id("users", "u1", values)


def test_plan_errors(db):
    for plan in (Plan(Op.SCAN, "users", limit=0), Plan(Op.SCAN, "users", limit=1001), Plan(Op.SCAN, "users", cursor="x"), Plan(Op.SCAN, "users", cursor="-1"), selector.one("notes", "notebook_id", "c"), selector.many("users", "name", "n"), Plan(Op.FIND, "users", "email"), Plan(Op.FIND, "users"), Plan(Op.SCAN, "nope")):
        with pytest.raises(E.InvalidPlan):
            db.execute(plan)
    with pytest.raises(E.TypeMismatch):
        db.upsert("users", user(1) | {"name": 3})


def test_snapshot_and_compaction_change_no_read(db):
    for i in range(3):
        db.upsert("users", user(1, name=f"n{i}"))
    db.insert_many("users", [user(i) for i in range(2, 9)])
    db.refresh_snapshot("users")
    db.write_many([change.remove_id("users", "u2"), change.edit_id("users", "u3", {"name": "late"})])
    whole = db.live("users").orderBy("id").collect()
    assert db.store.state().tables["users"].snapshot and {r.id for r in whole} == {"u1", "u3", "u4", "u5", "u6", "u7", "u8"}
    report = db.compact("users")
    assert report["rows"] == 7 and report["ops_before"] == 12 and report["ops_after"] == 7
    assert db.live("users").orderBy("id").collect() == whole
    assert [r.tx_id for r in db.log("users").orderBy("tx_id").collect()] == list(range(13, 20))
    assert db.insert("users", user(50)).tx_id == 20
    assert db.live("users", 2).count() == 1  # an old version


def test_two_writers(spark, db):
    other = Database.open(spark, db.options.root, "main", SCHEMA)
    publish, raced = db.store.publish, []

    def late(state):
        if not raced:
            raced.append(other.insert("users", user(77)))
        publish(state)

    db.store.publish = late
    assert db.insert("users", user(78)).tx_id == 2 and raced[0].tx_id == 1
    assert db.count("users") == 2


def test_schema_growth(spark, tmp_path):
    Database.open(spark, str(tmp_path), "w", "a { id id x text }").insert("a", {"id": "1", "x": "y"})
    grown = Database.open(spark, str(tmp_path), "w", "a { id id x text } b { id id }")
    assert grown.count("a") == 1 and grown.count("b") == 0
    with pytest.raises(E.CorruptData):
        Database.open(spark, str(tmp_path), "w", "a { id id x int }").count("a")


def test_frames(spark, db):
    rows = spark.range(500).select(F.format_string("u%04d", "id").alias("id"), F.format_string("%d@x", "id").alias("email"), F.lit("n").alias("name"))
    assert db.insert_frame("users", rows) == 500
    assert db.log("users").agg(F.min("tx_id"), F.max("tx_id"), F.count_distinct("tx_id")).first()[:] == (1, 500, 500)
    edits = rows.where("id < 'u0010'").select(F.monotonically_increasing_id().alias("seq"), F.lit("patch").alias("kind"), F.lit("email").alias("lookup"), F.col("email").alias("key"), F.lit("new").alias("name"))
    assert db.write_frame("users", edits) == 10 and db.live("users").where("name = 'new'").count() == 10
    with pytest.raises(E.AlreadyExists):
        db.insert_frame("users", rows.limit(3))


def test_many_gets_in_one_job(spark, db):
    db.insert_many("users", [user(i) for i in range(9)])
    ids = lambda rows: sorted(r.id for r in rows.collect())
    assert ids(db.get_each("users", "id", ["u1", "u5", "nope"])) == ["u1", "u5"]
    assert ids(db.get_each("users", "email", spark.createDataFrame([("2@x",), ("2@x",)], "k string"))) == ["u2"]
    assert ids(db.get_each("users", "id", [])) == []
    with pytest.raises(E.InvalidPlan):
        db.get_each("notes", "notebook_id", ["c"])


def test_several_tables_in_one_version(db):
    note = {"id": "n1", "notebook_id": "b", "title": "t", "body": "x", "updated_at": 1}
    out = db.write_together([change.add("users", user(1)), change.set("notes", note), change.add("users", user(2))])
    assert [r.tx_id for r in out["users"]] == [1, 2] and [r.tx_id for r in out["notes"]] == [3]
    before = db.store.state()
    with pytest.raises(E.AlreadyExists):
        db.write_together([change.set("notes", note | {"id": "n2"}), change.add("users", user(1))])
    assert db.store.state() == before and db.count("notes") == 1 and db.write_together([]) == {}


def test_gathered_batches_and_freshness(db):
    b = WriteBatch.inserts("users").push(change.add("users", user(1))).push(change.add("users", user(2)))
    with pytest.raises(E.InvalidInput):
        b.push(change.set("users", user(3)))
    with pytest.raises(E.InvalidInput):
        b.push(change.add("notes", {}))
    assert len(db.write_batch(b)) == 2 and not db.snapshot_is_fresh("users")
    db.refresh_snapshot("users")
    assert db.snapshot_is_fresh("users")
    db.users.remove("u1")
    assert not db.snapshot_is_fresh("users") and db.count("users") == 1


def test_command_line(tmp_path, capsys):
    from logloom.__main__ import main

    (tmp_path / "s").write_text("a { id id n int }")
    assert main(["--version"]) == main(["help"]) == main(["generate", "stubs", str(tmp_path / "s")]) == 0
    assert "n: int" in capsys.readouterr().out
    assert main(["nonsense"]) == main(["generate", "stubs"]) == 2 and main(["generate", "stubs", str(tmp_path / "none")]) == 1


def test_names_of_tables(db):
    db.users.insert(user(1))
    assert db.users.get("u1")["email"] == "1@x" and db.users.get(db.users.key.email("1@x"))["id"] == "u1"
    assert db.get(db.users.by.email("1@x"))["id"] == "u1" and db.users.scan().rows == [user(1)]
    assert db.get(db.notes.by.notebook_id("c").page(5)).rows == []
    db.users.patch(db.users.key.email("1@x"), {"name": "z"})
    assert db.users.find("email", "1@x")[0]["name"] == "z" and db.users.count() == 1
    with pytest.raises(E.InvalidPlan):
        db.users.patch(Key("notes", "id", "u1"), {"name": "q"})
    with pytest.raises(AttributeError):
        db.users.key.name("x")
    db.users.remove("u1")
    assert db.users.all().op is Op.SCAN and db.users.count() == 0


def test_json(db):
    ask = lambda **r: json.loads(db.execute_json(json.dumps(r)))
    row = {"id": "a", "email": "e", "age": "9007199254740993", "score": 1.5, "active": True}
    assert ask(op="add", table="all_kinds", value=row)["result"] == {"tx_id": "1", "operation": "put", "bytes_written": str(len("R\t1\ta\te\t9007199254740993\t1.5\ttrue\n"))}
    assert ask(op="get", table="all_kinds", lookup="id", key="a")["result"] == row
    assert ask(op="find", table="all_kinds", lookup="age", key="9007199254740993")["result"]["rows"] == [row]
    assert ask(op="find", table="all_kinds", lookup="score", key=1.5)["result"]["rows"] == [row]
    assert ask(op="find", table="all_kinds", lookup="active", key=True)["result"]["next_cursor"] is None
    assert ask(op="count", table="all_kinds")["result"] == "1"
    code = lambda **r: ask(**r)["error"]["code"]
    assert code(op="add", table="all_kinds", value=row) == "already_exists"
    assert code(op="add", table="nope", value={}) == "unknown_table"
    assert code(op="add", table="all_kinds", value=row | {"x": 1}) == "unknown_field"
    assert code(op="add", table="all_kinds", value=row | {"age": 1.5}) == "type_mismatch"
    assert code(op="get", table="all_kinds", lookup="nope", key="a") == "unknown_lookup"
    assert code(op="edit", table="all_kinds", lookup="id", key="zz", value={"email": "q"}) == "not_found"
    assert code(op="scan", table="all_kinds", limit=0) == "invalid_plan"
    assert code(op="scan", table="all_kinds", schema_hash="0") == "schema_mismatch"
    assert ask(op="write_many", changes=[{"kind": "edit", "table": "all_kinds", "lookup": "email", "key": "e", "patch": {"age": 5}}, {"kind": "set", "table": "all_kinds", "row": row | {"id": "b", "email": "f"}}])["ok"]


def test_watch(spark, db, tmp_path):
    from logloom.streaming.watch import feed, live_stream, operations, watch

    db.insert("users", user(1))
    seen = []
    check = str(tmp_path / "checkpoint")
    look = lambda: watch(db, selector.count("users"), lambda v, rows: seen.append(rows.first().n), check).awaitTermination()
    look()
    db.insert("users", user(2))
    look()
    assert seen == [1, 2]
    db.write_many([change.edit_id("users", "u1", {"name": "new"})])
    with pytest.raises(E.AlreadyExists):
        db.insert("users", user(1))
    db.compact("users")
    db.users.remove("u2")
    folder, schema = str(tmp_path / "feed"), db.schema.table("users")
    for _ in range(2):
        feed(db, "users", folder, str(tmp_path / "feed-checkpoint")).awaitTermination()
    told = spark.read.parquet(folder).orderBy("tx_id").collect()
    assert [(r.op, r.id) for r in told] == [("R", "u1"), ("R", "u2"), ("R", "u1"), ("D", "u2")]
    query = live_stream(operations(spark, folder, schema), schema).writeStream.outputMode("update").format("memory").queryName("users_live").trigger(availableNow=True).start()
    query.awaitTermination()
    last = {r.id: r for r in spark.table("users_live").collect()}
    assert last["u1"].name == "new" and last["u2"].op == "D"


def test_torn_and_foreign_manifests(db):
    db.insert("users", user(1))
    path = f"{db.store_root}/commit-log/{3:020d}.json".removeprefix("file:")
    with open(path, "w") as f:
        f.write('{"version": 3, "nex')
    with pytest.raises(E.CorruptData, match="bad workspace revision"):
        db.count("users")


def test_damaged_snapshots_are_rebuilt(spark, db):
    db.insert_many("users", [user(i) for i in range(30)])
    db.refresh_snapshot("users")
    entry = db.store.state().tables["users"]
    for damage in ("lost", "cut"):
        path = f"{db.store_root}/{db.store.state().tables['users'].snapshot}/{min(db.store.state().tables['users'].snapshot_files)}".removeprefix("file:")
        os.unlink(path)
        if damage == "cut":
            with open(path, "w") as f:
                f.write("PAR1")
        again = Database.open(spark, db.options.root, "main", SCHEMA)
        assert again.count("users") == 30 and again.get_by_id("users", "u7") == user(7)
        again.ensure_current("users")
        assert again.store.state().tables["users"].snapshot != entry.snapshot and again.count("users") == 30
        entry = again.store.state().tables["users"]
        version = again.store.state().version
        again.ensure_current("users")
        assert again.store.state().version == version
        db = again


def test_snapshots_follow_by_themselves(spark, tmp_path):
    from logloom.api import DatabaseOptions
    from logloom.schema import parse_schema

    db = Database(spark, DatabaseOptions(str(tmp_path), "auto", parse_schema(SCHEMA), snapshot_every=3))
    for i in range(7):
        db.insert("users", user(i))
    entry = db.store.state().tables["users"]
    assert entry.snapshot and entry.after_snapshot == 6 and len(entry.logs) == 7 and db.count("users") == 7


def test_resolvers_see_what_they_change(spark, db):
    db.insert("users", user(1, name="a"))
    other, raced = Database.open(spark, db.options.root, "main", SCHEMA), []

    def longer(snapshot):
        row = snapshot.get_unique_lookup("email", "1@x")
        if not raced:
            raced.append(other.patch_by_id("users", "u1", {"name": "late"}))
        return [change.edit_id("users", "u1", {"name": row["name"] + "!"})]

    assert db.resolve_and_append("users", longer)[0].tx_id == 3
    assert db.get_by_id("users", "u1")["name"] == "late!"
    assert db.resolve_and_append("users", lambda s: []) == [] and db.resolve_and_append("users", lambda s: [change.remove_id("users", "u1")] if s.live().count() == 1 else [])[0].operation == "delete"
    with pytest.raises(E.InvalidPlan):
        db.resolve_and_append("users", lambda s: [change.remove_id("notes", "n")])


def test_small_batches_are_judged_as_large_ones(spark, db, monkeypatch):
    from logloom.operators import small

    rng = random.Random(4)
    rows = [{"id": f"k{i}", "email": f"e{i}", "age": i, "score": float(i - 2), "active": i % 2 == 0} for i in range(6)]
    db.insert_many("all_kinds", rows)
    new = lambda: {"id": f"k{rng.randrange(9)}", "email": f"e{rng.randrange(9)}", "age": 1, "score": -0.0, "active": True}

    def one():
        kind = rng.randrange(4)
        if kind == 0:
            return change.set("all_kinds", new())
        lookup, key = rng.choice([("id", f"k{rng.randrange(8)}"), ("email", f"e{rng.randrange(8)}")])
        return change.remove("all_kinds", lookup, key) if kind == 1 else change.edit("all_kinds", lookup, key, {"email": f"e{rng.randrange(9)}"} if kind == 2 else {"age": rng.randrange(99)})

    batches = [[one() for _ in range(rng.randrange(1, 5))] for _ in range(8)] + [[change.add("all_kinds", new()) for _ in range(2)] for _ in range(3)]
    batches += [[change.edit("all_kinds", "email", "e5", {"email": "e4"}), change.edit_id("all_kinds", "k4", {"email": "e5"})], [change.add("all_kinds", new() | {"id": "k50", "email": "e50"})], [change.remove("all_kinds", "email", "e4"), change.set("all_kinds", new() | {"id": "k4", "email": "e4"})]]
    outcomes = []
    for most in (1000, 0):
        monkeypatch.setattr(small, "SMALL", most)
        own = Database.open(spark, db.options.root, f"w{most}", SCHEMA)
        own.insert_many("all_kinds", rows)
        told = []
        for b in batches:
            try:
                told.append([(r.tx_id, r.operation, r.bytes_written) for r in own.write_many(b)])
            except E.EngineError as e:
                told.append((type(e), str(e)))
        outcomes.append((told, sorted(map(tuple, own.live("all_kinds").collect()))))
    assert outcomes[0] == outcomes[1] and any(isinstance(t, list) for t in outcomes[0][0]) and any(isinstance(t, tuple) for t in outcomes[0][0])


def test_zeros_are_different_keys(spark, tmp_path):
    db = Database.open(spark, str(tmp_path), "z", "t { id id x float lookup x unique }")
    db.insert_many("t", [{"id": "a", "x": 0.0}, {"id": "b", "x": -0.0}])
    assert db.get_by("t", "x", "0")["id"] == "a" and db.get_by("t", "x", "-0")["id"] == "b"
    rows = spark.createDataFrame([("c", 1.0), ("d", -0.0)], "id string, x double")
    with pytest.raises(E.AlreadyExists, match="already used by row `b`"):
        db.insert_frame("t", rows)
    assert db.insert_frame("t", rows.where("x > 0")) == 1


def test_deep_pages(db, monkeypatch):
    from logloom.plans import request

    db.insert_many("users", [user(f"{i:03}") for i in range(60)])
    want = [db.scan("users", 7, str(c)) for c in (0, 30, 56, 60)]
    monkeypatch.setattr(request, "DEEP", -1)
    got = [db.scan("users", 7, str(c)) for c in (0, 30, 56, 60)]
    assert [(p.rows, p.next_cursor) for p in got] == [(p.rows, p.next_cursor) for p in want] and got[1].next_cursor == "37"
    assert db.scan("users", cursor=str(2**40)).rows == []


def test_held_tables_and_vacuum(spark, db):
    for i in range(4):
        db.insert("users", user(i))
    db.hold("users")
    assert db.count("users") == 4 and "InMemory" in db.live("users")._jdf.queryExecution().executedPlan().toString()
    db.insert("users", user(9))
    assert db.count("users") == 5
    db.let_go("users")
    db.compact("users")
    db.refresh_snapshot("users")
    assert db.vacuum(keep=1) > 0  # old versions; files are too young
    assert db.vacuum(keep=1, older_than=-5) == 5 and db.count("users") == 5 and db.store.versions() == [8]


def test_client(spark, tmp_path):
    from logloom.client import Client, UniqueKey, int64

    (tmp_path / "s").write_text(SCHEMA)
    client = Client(str(tmp_path / "root"), "w", str(tmp_path / "s"))
    database = Database.open(spark, client.root, "w", SCHEMA)
    client.invoke = lambda **o: _answer(database, {"schema_hash": client.schema.declared_hash(), **o})
    row = {"id": "a", "email": "e", "age": 2**62, "score": 1.5, "active": True}
    client.init()
    assert client.add("all_kinds", row)["tx_id"] == "1" and client.get(UniqueKey("all_kinds", "email", "e")) == row
    assert client.find("all_kinds", "age", 2**62) == ([row], None) and client.count("all_kinds") == 1
    client.edit("all_kinds", UniqueKey("all_kinds", "id", "a"), {"age": -1})
    assert client.scan("all_kinds", 5)[0][0]["age"] == -1
    client.remove("all_kinds", UniqueKey("all_kinds", "id", "a"))
    for code, act in (("invalid_target", lambda: client.edit("users", UniqueKey("notes", "id", "a"), {})), ("integer_out_of_range", lambda: int64(2**63)), ("not_found", lambda: client.remove("all_kinds", UniqueKey("all_kinds", "id", "a"))), ("bridge_failed", lambda: Client(client.root, "w", client.schema_path, ["false"]).count("users")), ("bridge_failed", lambda: Client(client.root, "w", client.schema_path, ["no such program"]).count("users")), ("invalid_response", lambda: Client(client.root, "w", client.schema_path, ["echo"]).count("users"))):
        with pytest.raises(E.ClientError) as told:
            act()
        assert told.value.code == code
    with pytest.raises(E.ClientError, match="schema_hash"):
        database.execute_json('{"op": "init"}', require_hash=True)


def _answer(database, request):
    told = json.loads(database.execute_json(json.dumps(request), require_hash=True))
    if not told["ok"]:
        raise E.ClientError(told["error"]["code"], told["error"]["message"])
    return told["result"]

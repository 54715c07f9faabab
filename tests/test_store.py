import math

import pytest
from model import entity_ids
from pyspark.sql import functions as F

from waypost import render
from waypost.errors import InvalidOperation, NotFound, PathError
from waypost.functions import paths as P
from waypost.functions import values as V
from waypost.operators import entity, scan, where
from waypost.operators.where import Condition
from waypost.plans import language
from waypost.sources import shred as S
from waypost.store import EndpointStore
from waypost.streaming import subscribe

USERS = {
    "users.u1.name": "alice", "users.u1.active": True, "users.u1.age": 30, "users.u1.profile.city": "Lyon", "users.u1.tags.[0]": "x", "users.u1.tags.[2]": "z",
    "users.u10.name": "bob", "users.u10.active": False, "users.u10.age": 41.5, "users.u2.name": "o\"brien.x", "users.u2.age": 5, "users.u2.score": float("nan"), "users.u2.note": None,
    "users.u3.age": 5.0, "users.u3.score": -0.0, "users.u3.boss": V.Reference("users.u1"), "users.u3.photo": V.Binary(b"\x01\x02", "image/png"), "org.eu.users.e1.age": 7,
}


@pytest.fixture
def store(spark):
    return EndpointStore.in_memory(spark, USERS)


def test_demo_scenario(spark):
    store = EndpointStore.in_memory(spark)
    store.set("users.u-123456.username", "alice")
    store.set("users.u-123456.email", "alice@example.com")
    store.set("users.u-123456.active", True)
    assert store.get("users.u-123456.username") == "alice"
    assert store.get_entity("users.u-123456") == {"username": "alice", "email": "alice@example.com", "active": True}
    assert [(r["path"], r["v_str"]) for r in store.query("users.*.email").collect()] == [("users.u-123456.email", "alice@example.com")]
    assert store.index_stats() is None


def test_points(store):
    assert store.get("users.u2.note") is None and store.exists("users.u2.note") and not store.exists("users.u2")
    with pytest.raises(NotFound):
        store.get("users.u1")
    store.set("users.u1.age", 31)
    assert store.get("users.u1.age") == 31 and store.count() == len(USERS)
    store.delete("users.u1.age")
    with pytest.raises(NotFound):
        store.delete("users.u1.age")
    with pytest.raises(PathError):
        store.set("", 1)
    with pytest.raises(PathError):
        store.set("a.*", 1)
    assert store.count() == len(USERS) - 1
    assert store.get("users.u1.tags[2]") == "z"


def test_every_type_survives(store):
    store.flush()
    for path, value in USERS.items():
        got = store.get(path)
        assert (math.isnan(got) if isinstance(value, float) and math.isnan(value) else got == value and type(got) is type(value)), path


def test_counts_and_lists(store):
    assert store.count_prefix("users.u1") == 6 and {r["path"] for r in store.list_prefix("users.u10").collect()} == {"users.u10.name", "users.u10.active", "users.u10.age"}
    assert store.list_prefix().count() == len(USERS)


def test_entities(store):
    assert store.get_entity("users.u1") == {"name": "alice", "active": True, "age": 30, "profile": {"city": "Lyon"}, "tags": ["x", None, "z"]}
    assert store.get_entity("users.u1.name") == "alice"
    with pytest.raises(NotFound):
        store.get_entity("users.nobody")
    rows = {r["id"]: r["json"] for r in store.entities("users").collect()}
    assert rows["u1"] == '{"active":true,"age":30,"name":"alice","profile":{"city":"Lyon"},"tags":["x",null,"z"]}'
    assert '"score":"NaN"' in rows["u2"] and '"boss":{"path":"users.u1","type":"reference"}' in rows["u3"]
    maps = {r["id"]: r["attributes"] for r in entity.maps(entity.with_entity(store.endpoints, ("users",))).collect()}
    assert maps["u1"]["profile.city"]["v_str"] == "Lyon"


def test_conflicts_fail(spark):
    for pairs in ({"a.x.b": 1, "a.x.b.c": 2}, {"a.x": 1, "a.x.b": 2}, {"a.x.b": 1, "a.x.b-c": 3, "a.x.b.c": 2}):
        ep = S.from_pairs(spark, pairs)
        with pytest.raises(Exception, match="conflicting shapes"):
            entity.maps(entity.with_entity(ep, ("a",))).collect()
        with pytest.raises(InvalidOperation):
            entity.reconstruct(ep, "a.x")
    assert entity.nest([(("b",), 1), (("b-c",), 2)]) == {"b": 1, "b-c": 2}
    with pytest.raises(InvalidOperation):
        entity.nest([(("b", "[0]"), 1), (("b", "c"), 2)])
    assert entity.nest([(("b", "[1]"), 1), (("b", "c"), 2)], compat=True) == {"b": {"": [None, 1], "c": 2}}
    assert entity.nest([(("list", "[0]", "x"), 1), (("list", "[2]", "x"), 2)]) == {"list": [{"x": 1}, None, {"x": 2}]}


@pytest.mark.parametrize(("rel", "op", "value"), [
    ("age", "==", 5), ("age", "==", 5.0), ("age", "!=", 5), ("age", "<", 31), ("age", ">=", 5), ("age", "<=", 30.0), ("age", ">", 5.0), ("active", "==", True), ("active", "!=", True), ("name", "==", "alice"), ("name", "<", "b"), ("name", "!=", 3),
    ("note", "==", None), ("note", "!=", None), ("score", "==", 0.0), ("score", ">", 1), ("score", "!=", 1.5), ("profile.city", "==", "Lyon"), ("boss", "==", V.Reference("users.u1")), ("photo", "==", V.Binary(b"\x01\x02", "image/png")),
])
def test_conditions_as_the_model(store, rel, op, value):
    got = where.matching_entities(store.endpoints, ("users",), Condition(tuple(rel.split(".")), op, value)).collect()
    assert {r["id"] for r in got} == entity_ids(USERS, ("users",), [(tuple(rel.split(".")), op, value)])


def test_condition_trees(store):
    tree = ("or", [("and", [Condition(("age",), ">", 20), Condition(("active",), "==", True)]), Condition(("note",), "==", None)])
    assert {r["id"] for r in where.matching_entities(store.endpoints, ("users",), tree).collect()} == {"u1", "u2"}
    assert {r["id"] for r in where.matching_entities(store.endpoints, ("org", "eu", "users"), Condition(("age",), "==", 7)).collect()} == {"e1"}
    assert where.matching_entities(store.endpoints, ("org", "eu", "users"), Condition(("age",), "==", 7), compat=True).count() == 0


def test_order_of_other_types_fails(store):
    for rel, value in (("active", 1), ("name", 3), ("age", "x")):
        with pytest.raises(Exception, match="InvalidOperation"):
            where.matching_entities(store.endpoints, ("users",), Condition((rel,), "<", value)).collect()
    assert where.matching_entities(store.endpoints, ("users",), Condition(("nothing",), "<", 1)).count() == 0


def test_filter_is_one_scan_and_one_exchange(spark, tmp_path):
    S.from_pairs(spark, USERS | {"z.z": 1}).write.partitionBy("root").parquet(str(tmp_path / "ep"))
    ep = spark.read.parquet(str(tmp_path / "ep"))
    tree = ("and", [Condition(("active",), "==", True), Condition(("age",), ">", 20)])
    plan = where.matching_entities(ep, ("users",), tree)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1


def test_language(store):
    ids = lambda q: sorted(r["id"] for r in store.ql(q).collect())
    assert store.ql('{ users.u9.name = "new"; users.u9.age = 1; return users.u9 }') == {"name": "new", "age": 1}
    assert store.ql("{ delete users.u9.name; return users.u9 }") == {"age": 1}
    assert store.ql("{ users.u9.age = users.u1.age; return users.u9.age }") == 30
    assert store.ql("{ users.u9.copy = users.u10; }") is True and store.get("users.u9.copy") == '{"active":false,"age":41.5,"name":"bob"}'
    assert ids("{ return users where their.active == true && their.age > 29 }") == ["u1"]
    assert ids("{ return users where 31 > their.age }") == ["u1", "u2", "u3", "u9"]
    assert ids('{ return users where their.name == "bob" || their.age <= 5 }') == ["u10", "u2", "u3"]
    assert ids('{ return users where (their.name == "bob" || their.age == 30) && their.active == true } // end') == ["u1"]
    assert sorted(r["path"] for r in store.ql("{ return users.*.name }").collect()) == ["users.u1.name", "users.u10.name", "users.u2.name"]
    assert store.ql('{ return count("users.u1") }') == 6 and store.ql("{ return count(users.*.age) }") == 5 and store.ql("{ return count(users.u1) }") == 6
    assert store.ql('{ cfg.target = "users.u10"; return count(cfg.target) }') == 3
    assert store.ql("{ return users.u1.{ who: name, at: { town: profile.city }, missing } }") == '{"who":"alice","at":{"town":"Lyon"}}'
    assert store.ql("{ /* c */ a.b = 5.0; return a.b }") == 5 and store.ql("{ a.c = 2.50; return a.c }") == 2.5 and store.ql("{ a.d = -0.5; return a.d }") == -0.5
    assert store.ql("{ orders.17.x = null; return orders.17.x }") is None and store.ql("{ trueish.x = 1; return trueish.x }") == 1
    assert store.ql("{ t.[1].v = 1; t.[0].v = 2; return t }") == [{"v": 2}, {"v": 1}]
    assert store.ql("{ return now() }").endswith("+00:00") and len(store.ql("{ return uuid() }")) == 36


@pytest.mark.parametrize("text", [
    "", "{ }", "{ return }", "return a", "{ a.b = 1 }", "{ a = 1; return a } x", "{ return their.x }", "{ return nothing() }", "{ return count() }", "{ return users where their.a == their.b }", "{ return users where their.a ~ 1 }", "{ return users where a.b == 1 }",
    "{ return 1 where their.a == 1 }", "{ return users where their == 1 }", "{ return users where their.a < true }", "{ delete a.b }", "{ a.[x] = 1; }", "{ return \"a }", "{ a.* = 1; }", "{ return count(1) }", "{ return count(\"\") }",
])
def test_language_errors(store, text):
    with pytest.raises((InvalidOperation, PathError)):
        store.ql(text)


def test_a_failing_query_writes_nothing(store):
    with pytest.raises(NotFound):
        store.ql("{ a.b = 1; delete no.such; c.d = 2; }")
    assert not store.exists("a.b")


def test_compat(spark):
    old = EndpointStore.in_memory(spark, USERS, compat=True)
    for text in ("{ return users where their.age <= 5 }", "{ return users.*.name }", "{ return orders.17.x }", "{ return users.u1.{ name } }", "{ return users where (their.age == 5) }"):
        with pytest.raises(InvalidOperation):
            old.ql(text)
    assert old.ql('{ return users where their.name == "bob" || their.active == false }') == '["{"active":false,"age":41.5,"name":"bob"}"]'
    assert old.ql('{ return users where their.name == "bob" || their.active == true }') == "[]"
    assert sorted(r["path"] for r in old.query("nothing.**.city").collect()) == ["users.u1.profile.city"]
    assert old.ql("{ return org.eu.users where their.age == 7 }") == "[]"
    with pytest.raises(NotFound):
        old.ql("{ a.b = 1; delete no.such; }")
    assert old.get("a.b") == 1  # no rollback
    assert old.get_entity("users.u1.tags") == {"": ["x", None, "z"]}


def test_persistence(spark, tmp_path):
    at = str(tmp_path / "store")
    store = EndpointStore.open(spark, at)
    for path, value in USERS.items():
        store.set(path, value)
    store.flush()
    store.ql('{ users.u1.name = "alicia"; delete users.u10.name; }')
    assert store.index_stats() == {"total_operations": len(USERS), "total_adds": len(USERS), "total_removes": 0, "pending_operations": 2}
    store.flush()
    again = EndpointStore.open(spark, at)
    assert again.get("users.u1.name") == "alicia" and not again.exists("users.u10.name") and again.count() == len(USERS) - 1
    assert [r["v_str"] for r in again.history("users.u1.name").collect()] == ["alice", "alicia"]
    assert again.snapshot(until_seq=len(USERS)).where("path = 'users.u1.name'").first()["v_str"] == "alice"
    again.compact()
    assert again.log.isEmpty() if again.log is not None else True
    again.set("users.u1.name", "al")
    again.flush()
    third = EndpointStore.open(spark, at)
    assert third.get("users.u1.name") == "al" and third.count() == len(USERS) - 1
    third.load(S.from_pairs(spark, {"bulk.a": 1, "bulk.b": 2, "users.u1.name": "z"}))
    assert third.count_prefix("bulk") == 2 and third.get("users.u1.name") == "z"


def test_subscription(spark, tmp_path):
    at = str(tmp_path / "store")
    store = EndpointStore.open(spark, at)
    store.set("users.u1.age", 10)
    store.flush()
    stream = subscribe.subscribe(spark, at, "users.*.age", F.col("v_int") > 5)
    running = stream.writeStream.format("memory").queryName("heard").start()
    try:
        running.processAllAvailable()
        store.set("users.u2.age", 3)
        store.set("users.u3.age", 30)
        store.set("orders.o1.age", 30)
        store.flush()
        running.processAllAvailable()
        assert sorted(r["path"] for r in spark.table("heard").collect()) == ["users.u1.age", "users.u3.age"]
    finally:
        running.stop()
    counted = subscribe.change_counts(subscribe.subscribe(spark, at, "**"), "1 hour", "1 hour").writeStream.format("memory").outputMode("complete").queryName("counted").start()
    try:
        counted.processAllAvailable()
        assert sum(r["n"] for r in spark.table("counted").collect()) == 4
    finally:
        counted.stop()


def test_value_lookup(store):
    paths = lambda df: sorted(r["path"] for r in df.collect())
    assert paths(store.find_by_value(5)) == ["users.u2.age"] and paths(store.find_by_value(5.0)) == ["users.u3.age"]
    assert paths(store.find_by_value("x", "users.**")) == ["users.u1.tags.[0]"]
    assert paths(scan.find_by_condition(store.endpoints, ">", 29)) == ["users.u1.age", "users.u10.age"]
    assert paths(scan.find_by_condition(store.endpoints, "<", "b", "users.*.name")) == ["users.u1.name"]


def test_value_index(spark, store, tmp_path):
    from waypost.operators.value_index import ValueIndex

    index = ValueIndex(store.endpoints)
    paths = lambda df: sorted(r["path"] for r in df.collect())
    assert paths(index.find_by_value("alice")) == []
    index.register("users.*.name")
    index.register("users.*.age")
    assert index.covers("users.u1.name") and not index.covers("users.u1.active")
    for _ in range(2):
        assert paths(index.find_by_value("alice")) == ["users.u1.name"] and paths(index.find_by_value(True)) == []
        assert paths(index.find_by_condition("<=", 5)) == ["users.u2.age", "users.u3.age"]
        index.materialize(str(tmp_path / "index"))
    index.unregister("users.*.name")
    assert paths(index.find_by_value("alice")) == []
    index.clear()
    assert paths(index.rows()) == []


def test_access_rules(store):
    from waypost.operators import access

    paths = lambda rules, **k: {r["path"] for r in access.visible(store.endpoints, rules, **k).collect()}
    assert paths([]) == set() and len(paths([], otherwise=True)) == len(USERS)
    assert paths([("users.**", True), ("users.*.age", False), ("users.u2.age", True)]) == {p for p in USERS if p.startswith("users.") and (not p.endswith(".age") or p == "users.u2.age")}
    assert paths([("users.*.name", False)], otherwise=True) == {p for p in USERS if not p.endswith(".name")}


def test_clear(spark, tmp_path):
    memory, kept = EndpointStore.in_memory(spark, {"a.b": 1}), EndpointStore.open(spark, str(tmp_path / "s"))
    kept.set("a.b", 1)
    for store in (memory, kept):
        store.clear()
        assert store.count() == 0
        store.set("a.c", 2)
        assert store.get_entity("a") == {"c": 2}
    assert EndpointStore.open(spark, str(tmp_path / "s")).count() == 0


def test_json_codec(spark):
    for told, value in ((5, 5), (5.0, 5.0), (1 << 64, float(1 << 64)), (True, True), (None, None), ("x", "x"), ([1, "a"], '[1,"a"]'), ({"a": 1}, '{"a":1}'), ({"type": "reference", "path": "a.b"}, V.Reference("a.b")), ({"type": "binary", "data": "AQI=", "mime": "m"}, V.Binary(b"\x01\x02", "m"))):
        got = V.json_to_value(told)
        assert got == value and type(got) is type(value)
    assert V.value_to_json(float("nan")) == "NaN" and V.value_to_json(V.Binary(b"\x01\x02", None)) == {"type": "binary", "data": "AQI="}
    with pytest.raises(InvalidOperation):
        V.json_to_value({"type": "binary", "data": "?"})
    texts = {"a.i": "5", "a.f": "5.5", "a.s": '"q\\"x"', "a.t": "true", "a.n": "null", "a.o": '{"k":1}', "a.r": '{"type":"reference","path":"x.y"}', "a.b": '{"type":"binary","data":"AQI=","mime":"m"}', "a.l": "[1,2]", "a.big": "18446744073709551616"}
    rows = S.from_json_text(spark.createDataFrame(list(texts.items()), "path string, value string")).collect()
    got = {r["path"]: V.from_row(r) for r in rows}
    assert got == {"a.i": 5, "a.f": 5.5, "a.s": 'q"x', "a.t": True, "a.n": None, "a.o": '{"k":1}', "a.r": V.Reference("x.y"), "a.b": V.Binary(b"\x01\x02", "m"), "a.l": "[1,2]", "a.big": float(1 << 64)}


def test_rendering():
    assert [render.text_value(v) for v in (None, True, 42, 3.14, 3.0, 1e7, "He\"y", V.Binary(b"", "image/jpeg"), V.Reference("a.b"))] == ["null", "true", "42", "3.14", "3", "10000000", '"He"y"', "[binary data: image/jpeg]", "@a.b"]
    assert render.pretty({"b": [1, None], "a": {}}) == '{\n  "a": {},\n  "b": [\n    1,\n    null\n  ]\n}'
    assert render.tagged({"a": True, "l": [None, 1]}) == {"Object": {"a": {"Boolean": True}, "l": {"Array": ["Null", {"Integer": 1}]}}}
    assert "| a    | integer | 1     |" in render.render({"a": 1}, "table") and render.render(5, "json") == "5"
    assert render.render_paths(["a.b"], "json") == '[\n  "a.b"\n]' and render.render_message("error", "no") == "Error: no"
    with pytest.raises(InvalidOperation):
        render.render(1, "xml")


def test_clients_interface(store):
    assert store.api_set("a.b", {"type": "reference", "path": "users.u1"}) == {"success": True, "error": None, "data": None}
    assert store.api_get("a.b")["data"] == {"type": "reference", "path": "users.u1"}
    assert not store.api_get("no.such")["success"] and not store.api_get("")["success"]
    assert store.api_query("{ return users where their.active == true }")["data"][0].startswith('{"active":true')
    assert len(store.api_list()["data"]) == len(USERS) + 1 and store.health()["success"]


def test_shredding_nested(spark):
    df = spark.sql("SELECT 1 AS k, struct('x' AS a, array(1.5D, NULL) AS l) AS s, map('m', 2) AS m, CAST(NULL AS INT) AS n, array(struct(1 AS q)) AS o, X'01' AS b, DATE'2024-01-02' AS d")
    got = {r["path"]: V.from_row(r) for r in S.shred(df, "t", S.keyed("k", "k")).collect()}
    assert got == {"t.k-1.k": 1, "t.k-1.s.a": "x", "t.k-1.s.l.[0]": 1.5, "t.k-1.s.l.[1]": None, "t.k-1.m.m": 2, "t.k-1.n": None, "t.k-1.o.[0].q": 1, "t.k-1.b": V.Binary(b"\x01"), "t.k-1.d": "2024-01-02"}


def test_parser_trees():
    q = language.parse("{ return a where their.x == 1 && their.y == 2 || their.z != 3 }")
    assert q.result.tree[0] == "or" and q.result.tree[1][0][0] == "and"
    assert language.parse("{ return f(a, g(1)) }").result == language.Call("f", (language.PathOf(("a",)), language.Call("g", (language.Literal(1),))))
    assert P.parse("a.b[0]") == language.parse("{ return a.b.[0] }").result.segments == language.parse("{ return a.b[0] }").result.segments

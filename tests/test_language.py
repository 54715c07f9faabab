"""Variables, lists, arithmetic and batches of the query language."""

import pytest

from waypost.errors import InvalidOperation, NotFound, WaypostError
from waypost.functions import values as V
from waypost.operators import analysis, entity, scan
from waypost.store import EndpointStore

USERS = {"users.a.name": "Ann", "users.a.age": 30, "users.a.friends.[0]": "b", "users.a.friends.[1]": "c", "users.b.name": "Bob", "users.b.age": 20, "users.c.name": "Cy", "users.c.age": 25}


@pytest.fixture(scope="module")
def store(spark):
    return EndpointStore.in_memory(spark, USERS)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("{ return 1 + 2 * 3 - 4 / 2 }", 5.0), ('{ return "a" + "b" }', "ab"), ("{ return 7 -2 }", 5), ("{ let x = 2; let y = x * x; return y }", 4), ("{ let u = users.a; return u.name }", "Ann"), ("{ let u = users.a; return u.friends[1] }", "c"),
        ('{ let id = "b"; return users[id].name }', "Bob"), ("{ let u = users.a; let f = u.friends[0]; return users[f].age }", 20), ("{ return sum(users.*.age) + 0 }", 75.0), ("{ return max(users.*.age) }", 30.0),
    ],
)
def test_values(store, text, want):
    assert store.ql(text) == want


def test_filters(store):
    ids = lambda text: sorted(r["id"] for r in store.ql(text).collect())
    assert ids('{ return users where their.name in ["Bob", "Cy", "Di"] }') == ["b", "c"]
    assert ids("{ return users where their.name in [] || their.age > 10 * 2 + 5 }") == ["a"]
    assert ids('{ let names = users.a.friends; return users where their.name in ["Ann"] && their.age >= 30 }') == ["a"]
    assert ids("{ let least = 24; return users where their.age > least }") == ["a", "c"]
    assert {r["path"] for r in store.ql('{ return endpoints(users.**) where path.includes("age") && value < 26 || value == "Ann" }').collect()} == {"users.b.age", "users.c.age", "users.a.name"}


def test_time(spark):
    store = EndpointStore.in_memory(spark, {"x.old.at": "2020-01-01T00:00:00+00:00", "x.new.at": "2999-01-01T00:00:00+00:00"})
    assert [r["id"] for r in store.ql("{ return x where their.at > now() - days(7) }").collect()] == ["new"]


def test_batch(spark):
    store = EndpointStore.in_memory(spark, {"users.a.name": "Ann"})
    got = store.ql('{ let id = "u-" + uuid(); batch(users[id]) { set ["name"] = "new"; set ["profile.bio"] = "x" set ["at"] = now() } return id }')
    assert got.startswith("u-") and store.get(f"users.{got}.profile.bio") == "x" and store.count() == 4
    with pytest.raises(NotFound):
        store.ql('{ batch(users.z) { set ["a"] = 1; set ["b"] = no.such } }')
    assert not store.exists("users.z.a")


def test_sorted(store):
    ids = lambda text: [r["id"] for r in store.ql(text).orderBy("place").collect()]
    assert ids("{ let found = users where their.age > 0; found = found.sort((a, b) => b.age - a.age); return found }") == ["a", "c", "b"]
    assert ids('{ let found = users where their.name != "Cy"; return found.sort((x, y) => x.age - y.age) }') == ["b", "a"]
    assert ids("{ let found = users where their.age > 0; return found.sort((a, b) => b.friends[0] - a.friends[0]) }")[0] == "a"  # others have none
    got = store.api_query("{ let found = users where their.age > 0; return found.sort((a, b) => a.age - b.age) }")["data"]
    assert ['"Bob"' in got[0], '"Cy"' in got[1], '"Ann"' in got[2]] == [True] * 3


def test_lists(store):
    assert store.ql("{ let x = [1, 2 * 3]; return x[1] }") == 6
    assert sorted(r["id"] for r in store.ql('{ let names = ["Bob", "Cy"]; return users where their.name in names }').collect()) == ["b", "c"]


def test_past(spark, tmp_path):
    store = EndpointStore.open(spark, str(tmp_path / "s"))
    for n in (1, 2):
        store.set("a.x", n)
        store.flush()
    store.delete("a.x")
    told = store.api_query("{ return history(a.x) }")["data"]
    assert told == ['{"seq":1,"deleted":false,"value":1}', '{"seq":2,"deleted":false,"value":2}', '{"seq":3,"deleted":true,"value":null}']
    assert store.ql('{ return history(a.x, from: "2999-01-01") }').count() == 0 and store.ql('{ return history(a.x, to: now() + days(1)) }').count() == 3
    assert store.ql("{ return snapshot(a, until: 1) }") == {"x": 1} and store.ql("{ return snapshot(a.x, until: 1 + 1) }") == 2
    with pytest.raises(NotFound):
        store.ql('{ return snapshot(a.x, as_of: "2000-01-01T00:00:00Z") }')


def test_relations(spark):
    ends = {"v.a.e.[0]": 1, "v.a.e.[1]": 0, "v.b.e.[0]": 1, "v.b.e.[1]": 1, "v.c.e.[0]": -1, "v.c.e.[1]": 0}
    ends |= {"p.a.friends.[0]": V.Reference("p.b"), "p.b.friends.[0]": V.Reference("p.c"), "p.b.friends.[1]": V.Reference("p.a")}
    store = EndpointStore.in_memory(spark, ends)
    ids = lambda text: [r["id"] for r in store.ql(text).orderBy("place").collect()]
    assert ids('{ return vector_search("v.*.e", [1, 0], limit: 2) }') == ["a", "b"] and ids("{ return vector_search(v.*.e, v.b.e, min_similarity: 0.5) }") == ["b", "a"]
    assert store.api_query("{ return related_of_related(p.*.friends) }")["data"] == ['{"id":"a","other":"c","n":1}']


def test_references_of_any_depth(spark):
    ends = {"a.x": V.Reference("b"), "a.y": V.Reference("b.c"), "a.z": V.Reference("b.c.d.e"), "a.t": V.Reference("b.l.[0]"), "a.u": V.Reference("no.c"), "a.v": V.Reference("b.c.no"), "b.c.d": 1, "b.l.[0]": 2}
    ep = EndpointStore.in_memory(spark, ends).endpoints
    assert sorted(r["path"] for r in analysis.dangling(ep, "a.*").collect()) == ["a.u", "a.v", "a.z"]
    assert sorted((r["from_path"], r["path"]) for r in scan.dereference(ep, ep).collect()) == [("a.t", "b.l.[0]"), ("a.x", "b.c.d"), ("a.x", "b.l.[0]"), ("a.y", "b.c.d")]


def test_large_entities_are_refused(store):
    assert len(entity.reconstruct(store.endpoints, "users", most=8)) == 3
    with pytest.raises(InvalidOperation):
        entity.reconstruct(store.endpoints, "users", most=7)


@pytest.mark.parametrize("text", ["{ return 1 + true }", "{ let u = users.a; return u.sort((a, b) => a.x - b.x) }", "{ let u = users where their.age > 0; return u.sort((a, b) => a.x - b.y) }", "{ return history(1) }", "{ return snapshot(users, at: 1) }", '{ return history(users.a.name, from: "x") }', '{ return vector_search("users.name", [1]) }', '{ return vector_search("users.*.name", ["x"]) }', "{ return 1 / 0 }", '{ return "x" - days(1) }', "{ let u = users.a; return u.nothing }", "{ let n = 2.5; return users[n].name }", "{ return endpoints(users.*) where their.a == 1 }", "{ return users where their.a in 5 }", "{ return days(\"x\") }", "{ let x = 1; return users where their.age in x }", "{ return sum(1) }"])
def test_rejected(store, text):
    with pytest.raises(WaypostError):
        store.ql(text)


def test_older_grammar_has_none_of_it(spark):
    old = EndpointStore.in_memory(spark, USERS, compat=True)
    for text in ("{ let x = 1; return x }", "{ return 1 + 1 }", '{ return users where their.name in ["Bob"] }'):
        with pytest.raises(InvalidOperation):
            old.ql(text)

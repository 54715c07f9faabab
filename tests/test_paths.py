import random

import pytest
from model import compat_match, segment_match

from waypost.errors import PathError
from waypost.functions import paths as P
from waypost.operators import scan
from waypost.sources import shred as S


def test_parse_and_print():
    path = P.parse("users.u-123456.profile.bio")
    assert path == ("users", "u-123456", "profile", "bio")
    assert P.text_of(path) == "users.u-123456.profile.bio"
    assert P.starts_with(path, P.parse("users.u-123456"))
    assert not P.starts_with(path, P.parse("users.u-1"))
    assert P.starts_with(path, P.parse("users.*.profile"))


def test_wildcards_are_recognised():
    assert P.parse("users.*.profile.bio")[1] == P.ONE and P.parse("users.**.bio")[1] == P.MANY
    assert P.has_wildcards(P.parse("a.*")) and not P.has_wildcards(P.parse("a.b"))


@pytest.mark.parametrize(("pattern", "path", "hit"), [
    ("users.*.email", "users.u-123456.email", True), ("users.*.email", "users.u-789012.email", True), ("users.*.email", "users.u-123456.profile", False),
    ("users.**.bio", "users.u-123456.bio", True), ("users.**.bio", "users.u-123456.profile.bio", True), ("users.**.bio", "users.u-123456.profile.social.bio", True), ("users.**.bio", "users.u-123456.profile", False),
    ("users.**.bio", "orders.o1.bio", False), ("users.**", "users", True), ("users.**", "orders.o1", False), ("**", "a.b", True),
])
def test_examples(pattern, path, hit):
    assert P.matches(P.parse(path), P.parse(pattern)) is hit


def test_array_indexes():
    assert P.parse("users.u-123456.tags[0]") == ("users", "u-123456", "tags", "[0]") == P.parse("users.u-123456.tags.[0]")
    assert P.parse("a.b[0][12]") == ("a", "b", "[0]", "[12]")
    assert P.parse("tags.[007]") == P.parse("tags.[+7]") == ("tags", "[7]")
    assert P.parse("tags[0]", compat=True) == ("tags[0]",)
    assert P.is_array_index("[3]") and not P.is_array_index("3") and P.as_index("[12]") == 12 and P.as_index("x") is None


def test_errors():
    with pytest.raises(PathError):
        P.parse("")
    with pytest.raises(PathError):
        P.checked_path("a.*")
    assert P.parse("a..b") == ("a", "", "b")


def test_compat_ignores_what_precedes():
    assert P.matches(P.parse("orders.o1.bio"), P.parse("users.**.bio"), compat=True)
    assert P.matches(P.parse("orders.o1"), P.parse("users.**"), compat=True)


def random_path(rng):
    return tuple(rng.choice(["a", "b", "c.d".replace(".", "-"), "[0]", "x+y", ""]) for _ in range(rng.randint(1, 5)))


def random_pattern(rng):
    return tuple(rng.choice(["a", "b", "c-d", "[0]", "x+y", "*", "**"]) for _ in range(rng.randint(1, 4)))


def test_random_patterns_on_the_driver():
    rng = random.Random(3)
    hits = 0
    for _ in range(6000):
        path, pattern = random_path(rng), random_pattern(rng)
        want = segment_match(pattern, path)
        hits += want
        assert P.matches(path, pattern) == want, (path, pattern)
        assert P.matches(path, pattern, True) == compat_match(pattern, path), (path, pattern)
    assert hits > 300


def test_random_patterns_in_spark(spark):
    rng = random.Random(5)
    stored = {P.text_of(p) for p in (random_path(rng) for _ in range(400)) if p != ("",)}
    ep = S.from_pairs(spark, dict.fromkeys(stored, 1)).cache()
    for compat in (False, True):
        for _ in range(25):
            pattern = random_pattern(rng)
            got = sorted(r["path"] for r in scan.query(ep, P.text_of(pattern), compat).collect())
            rule = compat_match if compat else segment_match
            assert got == sorted(p for p in stored if rule(pattern, P.parse(p))), pattern


def test_prefix_scans_in_spark(spark):
    rng = random.Random(6)
    stored = {P.text_of(p) for p in (random_path(rng) for _ in range(300)) if p != ("",)} | {"u.u1.x", "u.u10.x", "u.u1"}
    ep = S.from_pairs(spark, dict.fromkeys(stored, 1)).cache()
    assert {r["path"] for r in scan.list_prefix(ep, "u.u1").collect()} == {"u.u1", "u.u1.x"}
    assert scan.list_prefix(ep, "").count() == len(stored)
    for _ in range(20):
        prefix = random_pattern(rng)
        got = {r["path"] for r in scan.list_prefix(ep, P.text_of(prefix)).collect()}
        assert got == {p for p in stored if P.starts_with(P.parse(p), prefix)}, prefix


def test_predicates_reach_the_scan(spark, tmp_path):
    S.from_pairs(spark, {f"{r}.e{i}.x": i for r in "ab" for i in range(5)}).write.partitionBy("root").parquet(str(tmp_path / "ep"))
    plan = scan.query(spark.read.parquet(str(tmp_path / "ep")), "a.e1.*")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(root" in plan and "StringStartsWith(path,a.e1.)" in plan and "EqualTo(depth,3)" in plan

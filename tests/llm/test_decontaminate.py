import hashlib
import random
import re

from helpers_llm import DOCS, prose, with_clashes

from waypost.llm import decontaminate

ITEMS = "item_id long, text string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for i, text in items:
        w = words(text)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add("null" if i is None else str(i))
    lengths = {len(k) for k in windows}
    out = []
    for r in docs:
        w, hit, found = words(r[1]), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((r[0] is None, r[0] or 0, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def planted(rng):
    items = [(i, prose(rng, rng.choice([3, 9, 10, 11, 40]), 2000)) for i in range(40)] + [(50, None), (51, " ,. "), (52, "x"), (7, prose(rng, 20, 2000)), (None, prose(rng, 15, 2000)), (53, "w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1"), (54, "É W3 w4 Çx 😀 w5 w6 w7 w8 w9 w10 w11")]
    docs = []
    for i in range(80):
        text = prose(rng, 60).split()
        inside = words(rng.choice(items)[1])
        cut = rng.randint(0, 2)
        text[20:20] = [w.upper() + "," if rng.random() < 0.3 else w for w in inside[cut:]]
        docs.append((i, " ".join(text), "en", "s", 1))
    return docs + [(90, "w1 " * 200, "en", "s", 1), docs[3], docs[3], docs[3]], items


def test_contract(spark, rows, folder):
    data, items = planted(random.Random(5))
    data += [(1000 + (r[0] or 0), *r[1:]) if r[0] is not None else r for r in rows]
    got = decontaminate.op9_decontamination(spark, folder(documents=(data, DOCS), benchmark=(items, ITEMS))).collect()
    want = brute(data, items)
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got), key=repr) == want
    assert 10 < sum(w[-1] for w in want) < len(want)


def test_as_sql(spark, compare):
    d = "/root/testdata/sf0.001"
    compare(decontaminate.op9_decontamination(spark, d), decontaminate.ORACLE, d)


def test_clean(spark, docs):
    data, items = planted(random.Random(6))
    more = with_clashes(spark.createDataFrame(data, DOCS))
    got = decontaminate.clean(more, spark.createDataFrame(items, ITEMS))
    assert got.columns == more.columns
    want = sorted(r[1] for r in brute(data, items) if not r[-1])
    assert sorted(r["doc_id"] for r in got.collect()) == want


def test_empty(spark, docs):
    none = spark.createDataFrame([], ITEMS)
    assert decontaminate.contamination(docs, none).where("n_hit = 0").count() == docs.count() == decontaminate.clean(docs, none).count()
    assert decontaminate.contamination(docs.limit(0), spark.createDataFrame([(1, "a b")], ITEMS)).count() == 0


PHRASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa"


def test_proximity(spark):
    other = "delta and more"
    docs = [(1, PHRASE), (2, PHRASE.replace("delta", other)), (3, PHRASE.replace("gamma", "gamma extra")), (4, "alpha kappa alpha kappa"), (5, " ".join(PHRASE.split()[::-1])), (6, PHRASE.replace("alpha", "changed").replace("kappa", "too") + " x"), (7, "a " + PHRASE.replace("beta", "b").replace("theta", "t").replace("iota", "i")), (8, PHRASE.replace("eta theta", "theta eta")), (9, None), (2, PHRASE.replace("delta", other))]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, PHRASE), (10, "unseen words " + PHRASE)], ITEMS)).collect()
    assert {r["doc_id"]: r["items"] for r in got if r["items"]} == {1: ["9", "10"][::-1]}
    near = {r["doc_id"]: r["near_items"] for r in got if r["near_items"]}
    # 10's own windows begin with words that no document has, so they are near where most of them stands
    assert set(near) == {2, 3, 6, 8} and all("9" in x for x in near.values()) and len(got) == len(docs)


def test_near_items_as_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(7)
    data, items = planted(rng)
    seen, some = set(), []
    for r in data:
        if r[0] not in seen:  # SQL goes by id
            seen.add(r[0])
            w = (r[1] or "").split()
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(15, 35)
                w[k : k + rng.randint(0, 1)] = [rng.choice(["put", "in", "w5"])]
            some.append((r[0], " ".join(w), *r[2:]))
    spark.createDataFrame(some, DOCS).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, ITEMS).coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    # two items of id 7 and one without are, by SQL, items of these names as well
    want = con.execute(decontaminate.ORACLE.replace("CAST(item_id AS VARCHAR)", "coalesce(CAST(item_id AS VARCHAR), 'null')")).fetchall()
    got = decontaminate.op9_decontamination(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == sorted(want) and sum(r["near_items"] != "" for r in got) > 5


def test_tokens_are_filtered_before_they_are_shuffled(spark, docs):
    """No exchange takes tokens that the bitmap hasn't let through."""
    terms = spark.createDataFrame([("w1", 1)], "term string, hash long")
    own = decontaminate.keyed(docs, "doc_id", "text")
    plan = decontaminate.only(decontaminate.tokens(own), terms).join(terms.select("term"), "term").groupBy("term").count()._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    join = next(i for i, line in enumerate(lines) if "Join Inner" in line)
    below = lines[join:]
    assert any("__slot" in line or "__bits" in line for line in below) and any("Generate" in line for line in below)
    generate = next(i for i, line in enumerate(below) if "Generate posexplode" in line)
    assert any("Join LeftOuter" in line for line in below[:generate]), "the bitmap stands between the tokens and the join"

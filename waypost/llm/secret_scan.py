"""Secret scans with multipart credential linking.

Base findings are assignments of secrets, access identifiers and long
hexadecimal runs.  Weak candidates (short or oddly named secrets, account names,
addresses of services) mean nothing alone.  Each belongs to a part of a
credential: identifier, secret or endpoint.  An interval join within scopes of
``SCOPE`` code points around a candidate looks for a complementary part: an
identifier or endpoint counts beside a secret, a secret beside either.  Only weak
candidates with such company are reported, and the base findings always.

Only DataFrame operations.  Splitting a text by a pattern gives the gaps
between its matches, so running sums of lengths give the positions in code
points.  The join matches on document and scope; as candidates have length, a scope
holds a bounded number of them.

Defined cases: a null text is empty and has no findings; documents are told
apart by id and text, so repeated rows are scanned once and each get the
result; null ids and extra columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

SCOPE = 200
_GIVEN = r"""["']?\x20*[:=]\x20*["']?"""
#: No ASCII letter, digit or underscore before.
_EDGE = r"(?<![A-Za-z0-9_])"
#: Kind: (pattern, group that is measured, least code points of it, part, whether it is reported alone). In order of rank.
KINDS = {
    "assign": (rf"(?i:(password|passwd|secret|token|api_?key)){_GIVEN}([A-Za-z0-9+/_.=-]+)", 2, 8, "secret", True),
    "access": (r"AKIA[A-Z0-9]+", 0, 16, "identifier", True),
    "hex": (r"[0-9a-f]{32,}", 0, 32, "secret", True),
    "weak_identifier": (rf"(?i:{_EDGE}(user_?name|user_?id|client_?id|account|login|key_?id)){_GIVEN}([A-Za-z0-9_.@+-]+)", 2, 3, "identifier", False),
    "weak_secret": (rf"(?i:(password|passwd|secret|token|api_?key|{_EDGE}pwd|passphrase|{_EDGE}pin|signature|credential)){_GIVEN}([A-Za-z0-9+/_.=-]+)", 2, 4, "secret", False),
    "endpoint": (rf"""{_EDGE}(?i:(https?|ftps?|sftp|ssh|jdbc|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3|wss?))://([^\x00-\x20"'<>]+)|{_EDGE}(?i:(?:host|endpoint|server)[:=])[A-Za-z0-9.-]+""", 0, 8, "endpoint", False),
}
#: A text without any of these has no candidate of any kind.
HINT = r"(?i:passw|passphrase|secret|token|api_?key|credential|signature|pwd|pin|akia|user_?name|user_?id|client_?id|account|login|key_?id|://|host[:=]|endpoint[:=]|server[:=])|[0-9a-f]{32}"


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    doc_id, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    return docs.select(doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(F.lit(1), doc_id, text).alias("k1"), F.xxhash64(F.lit(2), doc_id, text).alias("k2"))


def pieces(kind: str) -> Column:
    """Of each match of a kind: length of the gap before it, its own, and that of its measured group."""
    pattern, group, least, _, _ = KINDS[kind]
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    measured = F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
    gaps = F.split("text", pattern, -1)
    each = F.transform(F.arrays_zip(found.alias("m"), measured.alias("v"), gaps.alias("g")), lambda x: F.struct(F.char_length(x["g"]).alias("gap"), F.char_length(x["m"]).alias("length"), (F.char_length(x["v"]) >= least).alias("fits")))
    return F.struct(F.lit(kind).alias("kind"), each.alias("each"))


def candidates(own: DataFrame) -> DataFrame:
    """(k1, k2, kind, start, end) of everything that fits a kind; ends are exclusive."""
    hinted = own.where(F.col("text").rlike(HINT))
    by_kind = hinted.select("k1", "k2", F.explode(F.array(*[pieces(k) for k in KINDS])).alias("p"))
    rows = by_kind.select("k1", "k2", "p.kind", F.posexplode("p.each").alias("nth", "x")).where("x.length is not null")
    single = rows.select("k1", "k2", "kind", "nth", "x.*").distinct()
    so_far = Window.partitionBy("k1", "k2", "kind").orderBy("nth")
    end = F.sum(F.col("gap").cast("long") + F.col("length")).over(so_far)
    return single.select("k1", "k2", "kind", "fits", F.col("length"), end.alias("end")).where("fits").select("k1", "k2", "kind", (F.col("end") - F.col("length")).alias("start"), "end")


def of_kind(field: int) -> Column:
    return F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v[field])])[F.col("kind")]


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak candidates of ``found`` that have a complementary part in their scope."""
    parts = found.withColumn("part", of_kind(3))
    alone = parts.where(of_kind(4)).select("k1", "k2", "start", "end")
    weak = parts.where(~of_kind(4)).join(alone, ["k1", "k2", "start", "end"], "left_anti").withColumn("scope", F.floor(F.col("start") / scope))
    reach = F.sequence(F.floor((F.col("start") - scope) / scope), F.floor((F.col("end") + scope) / scope))
    # a candidate is at most so far from the start of the scope it is looked for in, whatever its own length
    others = parts.select(F.col("k1").alias("o1"), F.col("k2").alias("o2"), F.col("part").alias("other"), F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.explode(reach).alias("o_scope"))
    complementary = (F.col("part") != F.col("other")) & ((F.col("part") == "secret") | (F.col("other") == "secret"))
    near = (F.col("o_start") <= F.col("start") + scope) & (F.col("o_end") >= F.col("start") - scope)
    same = (F.col("k1") == F.col("o1")) & (F.col("k2") == F.col("o2")) & (F.col("scope") == F.col("o_scope"))
    return weak.join(others, same & complementary & near, "left_semi").select("k1", "k2", "kind", "start", "end")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """Per document: doc_id and spans, an array of (start, rank, end, kind) in order."""
    own = keyed(docs, id_col, text_col)
    found = shared.written(candidates(own), "candidates")
    kept = found.where(of_kind(4)).union(linked(found, scope))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    by_doc = kept.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind"))).alias("spans"))
    both = own.drop("text").join(shared.written(by_doc, "spans"), ["k1", "k2"], "left")
    none = F.array().cast("array<struct<start: long, rank: long, end: long, kind: string>>")
    return both.select("doc_id", F.coalesce("spans", none).alias("spans"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base findings and linked weak ones of all ``documents``."""
    found = scan(shared.table(spark, sf_dir, "documents"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["rank"] <= 3)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def oracle() -> str:
    """The query in SQL for DuckDB; its patterns know a word's edge, but no looking behind."""
    parts = []
    for kind, (pattern, group, least, part, alone) in KINDS.items():
        p = pattern.replace(_EDGE, r"\b").replace("'", "''")
        parts.append(
            f"SELECT doc_id, '{kind}' AS kind, '{part}' AS part, {str(alone).lower()} AS alone, unnest(range(1, len(m) + 1)) AS nth, unnest(list_transform(m, lambda x: length(x))) AS n, unnest(list_transform(v, lambda x: length(x) >= {least})) AS fits, unnest(g[:len(m)]) AS gap FROM "
            f"(SELECT doc_id, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {group}) AS v, list_transform(string_split_regex(t, '{p}'), lambda x: length(x)) AS g FROM texts)"
        )
    rank = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS, 1)) + " END"
    text = lambda only: f"coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, {rank}){only}, '')"
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
pieces AS ({" UNION ALL ".join(parts)}),
placed AS (SELECT *, sum(gap + n) OVER (PARTITION BY doc_id, kind ORDER BY nth) AS e FROM pieces),
found AS (SELECT doc_id, kind, part, alone, CAST(e - n AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM placed WHERE fits),
kept AS (
  SELECT * FROM found WHERE alone UNION ALL
  SELECT * FROM found AS w WHERE NOT alone
  AND NOT EXISTS (SELECT 1 FROM found AS b WHERE b.alone AND b.doc_id = w.doc_id AND b.s = w.s AND b.e = w.e)
  AND EXISTS (SELECT 1 FROM found AS o WHERE o.doc_id = w.doc_id AND o.part <> w.part AND (o.part = 'secret' OR w.part = 'secret') AND o.s <= w.s + {SCOPE} AND o.e >= w.s - {SCOPE}))
SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
       sha256({text(" FILTER (alone)")}) AS base_sha256, {text(" FILTER (kind IS NOT NULL)")} AS spans
FROM texts LEFT JOIN kept USING (doc_id) GROUP BY doc_id
"""

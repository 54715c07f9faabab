"""Benchmark decontamination with a distributed positional inverted index.

The terms of the benchmark's windows are counted over the whole corpus, and the
postings (document, position) of every window's rarest terms are written as
the index.  Tokens meet a bitmap of fixed size first, so only those that may be such terms
are counted or joined, whatever the size of the benchmark; counts are added up before
they are joined.  A window's places are where its rarest term stands, less the
term's offset in it; the lists of the next rarest terms, adjusted by their own
offsets, are intersected with these, within ``SLACK`` words for proximity.  What is left is compared word by word
with the document.  An exact match has all words in their places; a proximity match
has the two rarest of the window's words that the corpus knows, and ``NEAR`` of all its
words, each at most ``SLACK`` from its place, so words changed, put in or left out don't hide it.

Only DataFrame operations.  The benchmark's terms are joined with the corpus's
tokens by whichever join Spark finds their measured size fit for.

Defined cases: null texts have no words, and neither documents nor items without
words match; an item shorter than a window is one window; items of one id
count as one, and a null id as the item ``null``; repeated documents each
get their row; extra columns are not looked at; an empty table on either side gives no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

WINDOW = 10
RAREST = 2
#: Words by which a term of a proximity match may be off, and the share of a window's terms that must be there.
SLACK, NEAR = 3, 0.8
#: Positions of a bucket, by which places within some slack are joined.
STRIDE = 32
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of digits, letters and everything beyond ASCII, as written; none for null."""
    return F.coalesce(F.array_remove(F.split(text, BETWEEN_WORDS), ""), F.array().cast("array<string>"))


def benchmark_windows(items: DataFrame, length: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item, phrase) of a benchmark; the phrase's words are joined by a space."""
    split = items.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")).alias("item"), words(F.col(f"`{text_col}`")).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - length + 1, F.lit(1)))
    return split.select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, length), " "))).alias("phrase")).select("item", shared.ascii_lower(F.col("phrase")).alias("phrase")).distinct()


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents by content: equal rows share their key, and all they contain."""
    doc_id, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    return docs.select(doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(F.lit(1), doc_id, text).alias("k1"), F.xxhash64(F.lit(2), doc_id, text).alias("k2"))


def tokens(docs: DataFrame) -> DataFrame:
    """(k1, k2, pos, term, hash) of every word of the documents."""
    split = docs.select("k1", "k2", F.posexplode(words(F.col("text"))).alias("pos", "word")).select("k1", "k2", "pos", shared.ascii_lower(F.col("word")).alias("term"))
    return split.withColumn("hash", F.xxhash64("term"))


def only(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows whose term may be one of ``terms`` (a written table with term and hash): most others are gone before any shuffle."""
    return shared.with_filter(rows, terms, "hash").where("maybe").drop("maybe")


class Index:
    """Places of the rarest terms of every window that the corpus may contain; with ``slack`` of all that it may nearly contain."""

    def __init__(self, docs: DataFrame, windows: DataFrame, slack: int = 0):
        self.slack = slack
        phrases = windows.select("phrase").distinct().withColumn("terms", F.split("phrase", " "))
        vocabulary = shared.written(phrases.select(F.explode("terms").alias("term")).distinct().withColumn("hash", F.xxhash64("term")), "vocabulary")
        seen = only(tokens(docs).select("term", "hash"), vocabulary).groupBy("term").agg(F.count("*").alias("n"))
        counts = shared.written(seen.join(vocabulary.select("term"), "term"), "counts")
        terms = phrases.select("phrase", F.size("terms").alias("length"), F.posexplode("terms").alias("offset", "term")).join(counts, "term")
        ranked = terms.groupBy("phrase", "length").agg(F.sort_array(F.collect_list(F.struct("n", "term", "offset"))).alias("by_n"))
        known = F.size("by_n")
        enough = known == F.col("length") if not slack else (known == F.col("length")) | (known >= F.greatest(NEAR * F.col("length"), F.lit(RAREST)))
        rarest = F.transform(F.sequence(F.lit(0), F.lit(RAREST - 1)), lambda i: F.element_at("by_n", F.least(i + 1, known)))
        self.probes = shared.written(ranked.where(enough).select("phrase", "length", (known == F.col("length")).alias("sure"), rarest.alias("probe")), "probes")
        indexed = shared.written(self.probes.select(F.explode("probe.term").alias("term")).distinct().withColumn("hash", F.xxhash64("term")), "terms")
        self.postings = shared.written(only(tokens(docs), indexed).join(indexed.select("term"), "term").select("k1", "k2", "pos", "term"), "postings")

    def places(self) -> DataFrame:
        """(k1, k2, start, phrase, length, sure) where a window's rarest terms all stand, each at most ``slack`` from its place; not ``sure``: only nearly."""
        first = self.probes.withColumn("term", F.col("probe")[0]["term"])
        at = self.postings.join(first, "term").withColumn("start", F.col("pos") - F.col("probe")[0]["offset"]).drop("term", "pos")
        at = at.where("start >= 0") if not self.slack else at.withColumn("sure", F.col("sure") & (F.col("start") >= 0))
        for i in range(1, RAREST):
            placed = at.withColumns({"term": F.col("probe")[i]["term"], "place": F.col("start") + F.col("probe")[i]["offset"]})
            if not self.slack:
                at = placed.withColumnRenamed("place", "pos").join(self.postings, ["k1", "k2", "term", "pos"], "left_semi").drop("term", "pos")
                continue
            bucket = lambda pos: F.floor(pos / STRIDE).cast("int")
            near = placed.withColumn("bucket", F.explode(F.sequence(bucket(F.col("place") - self.slack), bucket(F.col("place") + self.slack))))
            there = self.postings.withColumn("bucket", bucket(F.col("pos")))
            met = near.join(there, ["k1", "k2", "term", "bucket"]).where(F.abs(F.col("pos") - F.col("place")) <= self.slack)
            at = met.withColumn("sure", F.col("sure") & (F.col("pos") == F.col("place"))).groupBy("k1", "k2", "start", "phrase", "length", "probe").agg(F.bool_or("sure").alias("sure"))
        return at.select("k1", "k2", "start", "phrase", "length", "sure")  # without slack, a repeated document's places are repeated, too


def nearly(p: Column, slack: int) -> Column:
    """Whether enough of a place's terms stand within some slack, in the words ``w``."""

    def there(term: Column, i: Column) -> Column:
        place = p["start"] + i + 1  # from 1
        low = F.greatest(place - slack, F.lit(1))
        here = F.slice("w", low, F.greatest(place + slack - low + 1, F.lit(0)))
        return F.contains(F.concat(F.lit(" "), shared.ascii_lower(F.array_join(here, " ")), F.lit(" ")), F.concat(F.lit(" "), term, F.lit(" ")))

    found = F.filter(F.transform(F.split(p["phrase"], " "), there), lambda x: x)
    return F.size(found) >= NEAR * p["length"]


def matches(docs: DataFrame, items: DataFrame, length: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", slack: int = 0) -> tuple[DataFrame, DataFrame]:
    """Per document: doc_id, k1, k2, n_words, n_hit, phrases, near (with some slack, phrases of proximity matches that are not exact); and the windows (item, phrase)."""
    own = keyed(docs, id_col, text_col)
    windows = shared.written(benchmark_windows(items, length), "windows")
    places = Index(own, windows, slack).places()
    by_doc = shared.written(places.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "length", "phrase", "sure")).alias("places")), "places")
    filtered = shared.with_filter(own, by_doc, "k1")
    at = F.col("places")
    same = lambda p: shared.ascii_lower(F.array_join(F.slice("w", p["start"] + 1, p["length"]), " ")) == p["phrase"]
    exact = F.filter(F.filter(at, lambda p: p["sure"]), same)
    near = F.filter(at, lambda p: nearly(p, slack)) if slack else F.filter(at, lambda p: F.lit(False))
    hit = F.array_distinct(F.flatten(F.transform("exact", lambda p: F.sequence(p["start"], p["start"] + p["length"] - 1))))
    nothing = [F.lit(None).cast("array<string>").alias(c) for c in ("phrases", "near")]
    none = filtered.where(~F.col("maybe")).select("doc_id", "k1", "k2", F.size(words(F.col("text"))).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), *nothing)
    some = filtered.where("maybe").join(by_doc, ["k1", "k2"], "left").select("doc_id", "k1", "k2", "places", words(F.col("text")).alias("w"))
    compared = some.select("doc_id", "k1", "k2", F.size("w").cast("long").alias("n_words"), exact.alias("exact"), near.alias("near")).select(
        "doc_id", "k1", "k2", "n_words",
        F.when(F.col("exact").isNull(), 0).otherwise(F.size(hit)).cast("long").alias("n_hit"),
        F.array_distinct("exact.phrase").alias("phrases"),
        F.array_except(F.array_distinct("near.phrase"), F.col("exact.phrase")).alias("near"),
    )
    found = none.union(compared)
    return shared.written(found, "found"), windows


def clean(docs: DataFrame, items: DataFrame, length: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark."""
    found, _ = matches(docs, items, length, id_col, text_col)
    hit = shared.written(found.where("n_hit > 0").select("k1", "k2").distinct(), "hit")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keys = [F.xxhash64(F.lit(i), F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias(f"k{i}") for i in (1, 2)]
    filtered = shared.with_filter(docs.select(row.alias("row"), *keys), hit, "k1")
    return filtered.where(~F.col("maybe")).select("row.*").union(filtered.where("maybe").join(hit, ["k1", "k2"], "left_anti").select("row.*"))


def contamination(docs: DataFrame, items: DataFrame, length: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", slack: int = SLACK) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items (sorted as strings), near_items (those with proximity matches only)."""
    found, windows = matches(docs, items, length, id_col, text_col, slack)
    phrases = found.where("size(phrases) > 0 OR size(near) > 0").select("k1", "k2", F.explode(F.concat(F.transform("phrases", lambda x: F.struct(x.alias("phrase"), F.lit(True).alias("exact"))), F.transform("near", lambda x: F.struct(x.alias("phrase"), F.lit(False).alias("exact"))))).alias("x"))
    told = phrases.select("k1", "k2", "x.phrase", "x.exact").distinct().join(windows, "phrase")
    which = lambda exact: F.sort_array(F.collect_set(F.when(F.col("exact") == exact, F.col("item"))))
    by_doc = told.groupBy("k1", "k2").agg(which(True).alias("items"), which(False).alias("near"))
    out = found.drop("near").join(shared.written(by_doc, "items"), ["k1", "k2"], "left")
    of = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", "n_hit", F.size(of("items")).cast("long").alias("n_items"), of("items").alias("items"), of(F.array_except("near", "items")).alias("near_items"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all ``documents`` inside windows of ``benchmark``, and items that documents hold nearly."""
    found = contamination(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.array_join("near_items", ",").alias("near_items"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{shared.UPPER}', '{shared.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, coalesce(regexp_extract_all(translate(text, '{shared.UPPER}', '{shared.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
windows AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, len(w[i:i + 9]) AS n, array_to_string(w[i:i + 9], ' ') AS phrase FROM b, LATERAL unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(i) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM windows),
runs AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM d CROSS JOIN lengths, LATERAL unnest(range(1, len(w) - n + 2)) AS r(i)),
hits AS (SELECT doc_id, i, runs.n, item FROM runs JOIN windows USING (phrase)),
words_hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hits) GROUP BY doc_id),
found AS (SELECT DISTINCT doc_id, item FROM hits),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM found GROUP BY doc_id),
terms AS (SELECT phrase, n AS length, i - 1 AS nth, string_split(phrase, ' ')[i] AS term FROM (SELECT DISTINCT phrase, n FROM windows), LATERAL unnest(range(1, n + 1)) AS r(i)),
tokens AS (SELECT doc_id, i - 1 AS pos, w[i] AS term FROM d, LATERAL unnest(range(1, len(w) + 1)) AS r(i) WHERE w[i] IN (SELECT term FROM terms)),
counts AS (SELECT term, count(*) AS k FROM tokens GROUP BY term),
probes AS (SELECT phrase, length, list(term ORDER BY k, term, nth) AS rarest, list(nth ORDER BY k, term, nth) AS places FROM terms JOIN counts USING (term) GROUP BY phrase, length HAVING count(*) = length OR count(*) >= greatest({NEAR} * length, {RAREST})),
pairs AS (SELECT DISTINCT a.doc_id, phrase, length, a.pos - places[1] AS start FROM probes JOIN tokens AS a ON a.term = rarest[1] JOIN tokens AS b ON b.doc_id = a.doc_id AND b.term = rarest[least(2, len(rarest))]
          AND abs(b.pos - (a.pos - places[1] + places[least(2, len(rarest))])) <= {SLACK}),
near AS (SELECT doc_id, phrase FROM (SELECT DISTINCT p.doc_id, p.phrase, p.length, p.start, t.nth FROM pairs AS p JOIN terms AS t USING (phrase) JOIN tokens AS x ON x.doc_id = p.doc_id AND x.term = t.term AND x.pos BETWEEN p.start + t.nth - {SLACK} AND p.start + t.nth + {SLACK})
         GROUP BY doc_id, phrase, length, start HAVING count(*) >= {NEAR} * length),
near_items AS (SELECT doc_id, string_agg(item, ',' ORDER BY item) AS near_items FROM (SELECT DISTINCT doc_id, item FROM near JOIN windows USING (phrase) ANTI JOIN found USING (doc_id, item)) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(near_items, '') AS near_items
FROM d LEFT JOIN words_hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near_items USING (doc_id)
"""

"""Mixing sources to target weights by pivotal dependent rounding.

A source's target divided by its size is the number of copies every document of
it should get.  The whole part is given outright.  The fractions meet
in pairs: one document gains and the other loses, by equal numbers of words and in a
random direction that leaves both expectations as they are, until one of them is
whole.  So words taken stay exact all the way, and only the one document of a
source that remains fractional at the very end is rounded to the nearer
side, which other documents at the root make up for as far as their sizes allow.

Pairs form a reduction tree.  Documents of a source and of about one size are dealt
by a seeded hash into groups of about ``FAN``; a group keeps at most one
fractional document, and groups meet in the next level until at most
``LAST_OF_BAND`` documents of that size are left.  The root takes a source's
remaining documents from the largest to the smallest, so what is rounded in the
end is small.

That repair alone is without chance: it turns documents of a source's root whose words add
up to no more than half of that last document, so the expected words of all of a source's
documents together differ from rate by size by at most the size of one document.

A row that is repeated n times is one member of the tree: of its n copies of the
fraction p, the whole part of n * p is given outright and the remainder takes
part, so neither an array nor a task grows with the repeats.

Only DataFrame operations; a few numbers (the counts of the largest band and row, the total, where sharing stops)
reach the driver.  Sources are ranked by ranges of their order.

Defined cases: a null text or one without words has size zero and is never
taken; a null source is a source, the last; repeated rows each get their own copies, which differ by one at most
but for the source's one repaired; null ids and extra columns don't matter;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

FAN = 16
#: Fractional documents of about one size that a source's root takes; with all sizes a thousand or so.
LAST_OF_BAND = 64
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Per source: source_size and target; ``sized`` has source and size.

    Shares of the total by weight, but no more than ``most`` times a source's
    size.  In the order of size by weight, the sources at their limit come
    first, so running sums tell where sharing the rest stays below it.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    last = F.col("source").asc_nulls_last()
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights)).cast("int")).cast("long")
    weighed = shared.written(shared.ranked(per, [last], {}, "sources").select("source", "source_size", weight.alias("weight")), "weighed")
    total, total_weight = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    limit = F.col("source_size") * most
    ordered = shared.ranked(weighed, [(limit / F.col("weight")).asc(), last], {"limits": limit, "weights": F.col("weight")}, "by-limit")
    left, left_weight = F.lit(total or 0) - F.col("limits"), F.lit(total_weight or 0) - F.col("weights")
    told = shared.written(ordered.select("source", "source_size", "weight", "place", left.alias("left"), left_weight.alias("left_weight")), "targets")
    below = F.col("left") * F.col("weight") < limit * F.col("left_weight")
    free = told.where(below).agg(F.min(F.struct("place", "left", "left_weight")).alias("x")).first()["x"]
    if free is None:
        return told.select("source", "source_size", limit.cast("double").alias("target"))
    share = (F.lit(free["left"]) * F.col("weight")).cast("double") / F.lit(free["left_weight"])
    return told.select("source", "source_size", F.when(F.col("place") < free["place"], limit.cast("double")).otherwise(share).alias("target"))


def meet(a: Column, b: Column, level: int, seed: int) -> tuple[Column, Column]:
    """The copy probabilities of two fractional documents after they met."""
    ratio = b["size"] / a["size"]
    room_a, mass_a = 1 - a["p"], a["p"]
    mass_b, room_b = b["p"] * ratio, (1 - b["p"]) * ratio
    gain, loss = F.least(room_a, mass_b), F.least(mass_a, room_b)
    draw = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), a["h1"], b["h1"]), F.lit(1 << 53)) / float(1 << 53)
    gains = draw * (gain + loss) < loss
    new_a = F.when(gains, F.when(room_a <= mass_b, 1.0).otherwise(a["p"] + mass_b)).otherwise(F.when(mass_a <= room_b, 0.0).otherwise(a["p"] - room_b))
    new_b = F.when(gains, F.when(mass_b <= room_a, 0.0).otherwise(b["p"] - room_a / ratio)).otherwise(F.when(room_b <= mass_a, 1.0).otherwise(b["p"] + mass_a / ratio))
    return new_a, new_b


def settle(members: Column, kind: T.StructType, level: int, seed: int) -> Column:
    """Folds a group, largest first, to (open: the fractional member or null, done: the others)."""
    fields = kind.names
    with_p = lambda x, p: F.struct(*[p.alias("p") if f == "p" else x[f].alias(f) for f in fields]).cast(kind)
    state = lambda o, d: F.struct(o.cast(kind).alias("open"), d.cast(T.ArrayType(kind)).alias("done"))
    whole = lambda p: (p <= 1e-12) | (p >= 1 - 1e-12)

    def merge(acc: Column, x: Column) -> Column:
        a, done = acc["open"], acc["done"]
        pa, pb = meet(a, x, level, seed)
        na, nb = with_p(a, pa), with_p(x, pb)
        return (
            F.when(a.isNull(), state(x, done))
            .when(whole(pa) & whole(pb), state(F.lit(None), F.concat(done, F.array(na, nb))))
            .when(whole(pa), state(nb, F.concat(done, F.array(na))))
            .otherwise(state(na, F.concat(done, F.array(nb))))
        )

    return F.aggregate(F.sort_array(members, asc=False), state(F.lit(None), F.array().cast(T.ArrayType(kind))), merge)


def repaired(left: Column, done: Column, kind: T.StructType) -> Column:
    """All members of a root.  The fractional one is rounded to the nearer side, and the words this costs are made up by turning others, largest first, while any fits."""
    turned = lambda x: F.struct(*[(1 - x["p"]).alias("p") if f == "p" else x[f].alias(f) for f in kind.names]).cast(kind)
    need = F.coalesce((left["p"] - F.when(left["p"] >= 0.5, 1.0).otherwise(0.0)) * left["size"], F.lit(0.0))
    state = lambda n, d: F.struct(n.cast("double").alias("need"), d.cast(T.ArrayType(kind)).alias("done"))

    def merge(acc: Column, x: Column) -> Column:
        step = F.when(x["p"] >= 0.5, -x["size"]).otherwise(x["size"]).cast("double")
        fits = (step * acc["need"] > 0) & (F.abs(step) <= F.abs(acc["need"]))
        return F.when(fits, state(acc["need"] - step, F.concat(acc["done"], F.array(turned(x))))).otherwise(state(acc["need"], F.concat(acc["done"], F.array(x))))

    start = F.when(left.isNull(), F.array().cast(T.ArrayType(kind))).otherwise(F.array(left.cast(kind)))
    return F.aggregate(F.sort_array(done, asc=False), state(need, start), merge)["done"]


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 29, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """A row per distinct row of ``docs``: id, h1 and h2 (hashes of all its columns), source_size, target, size, n (how often it occurs), whole (copies of each), more (how many of the n get one more)."""
    sized = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), shared.word_count(F.col(f"`{text_col}`")).alias("size"), shared.row_hash(docs, 1).alias("h1"), shared.row_hash(docs, 2).alias("h2"))
    counted = shared.written(sized.groupBy("id", "source", "size", "h1", "h2").agg(F.count("*").alias("n")), "sizes")
    band = F.length(F.bin("size")).alias("band")  # sizes of a band differ by a factor of two at most
    units = counted.select("*", band)
    per_band = units.groupBy(F.col("source").alias("s"), F.col("band").alias("b")).agg(F.count("*").alias("n_band"))
    targets = source_targets(units.select("source", (F.col("size") * F.col("n")).alias("size")), weights, most)
    bands = shared.written(targets.join(per_band, targets["source"].eqNullSafe(per_band["s"])).drop("source"), "bands")
    largest = bands.agg(F.max("n_band")).first()[0] or 0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    more = F.when(F.col("size") > 0, F.col("n") * (rate - F.floor(rate))).otherwise(0.0)
    groups = F.when(F.col("n_band") > LAST_OF_BAND, F.ceil(F.col("n_band") / FAN)).otherwise(F.lit(0))
    placed = units.join(bands, units["source"].eqNullSafe(F.col("s")) & (units["band"] == F.col("b"))).select(
        "id", "h1", "h2", "n", "size", "source_size", "target", "band", groups.alias("groups"),
        F.floor(rate).alias("whole"), F.floor(more).alias("more"), (more - F.floor(more)).alias("p"),
        F.when(groups > 0, F.pmod(F.xxhash64(F.lit(seed), "h1"), groups)).alias("leaf"), F.col("s").alias("source"),
    )
    fractional = F.col("p") > 1e-12
    keys = ["source", "source_size", "target"]
    out = placed.where(~fractional).select("id", "h1", "h2", *keys, "size", "n", "whole", "more")
    fields = [("size", T.LongType()), ("h1", T.LongType()), ("h2", T.LongType()), ("id", placed.schema["id"].dataType), ("n", T.LongType()), ("whole", T.LongType()), ("more", T.LongType()), ("p", T.DoubleType())]
    kind = T.StructType([T.StructField(name, t, True) for name, t in fields])
    member = F.struct(*kind.names).cast(kind)
    given = (F.col("m.more") + (F.col("m.p") >= 0.5).cast("long")).alias("more")
    settled = lambda rows: rows.select("m.id", "m.h1", "m.h2", *keys, "m.size", "m.n", "m.whole", given)

    start = placed.where(fractional).select(*keys, "band", "groups", "leaf", member.alias("m"))
    last = start.where("groups = 0")
    at = start.where("groups > 0")
    level, width, left = 0, 1, -(-largest // FAN) if largest > LAST_OF_BAND else 0
    while left:
        by = [*keys, "band", "groups", F.floor(F.col("leaf") / width).cast("long").alias("g")]
        folded = shared.written(at.groupBy(*by).agg(settle(F.collect_list("m"), kind, level, seed).alias("s")), f"level-{level}")
        out = out.union(settled(folded.select(*keys, F.explode("s.done").alias("m"))))
        rest = folded.where("s.open is not null").select(*keys, "band", "groups", (F.col("g") * width).alias("leaf"), F.col("s.open").alias("m"))
        ready = F.ceil(F.col("groups") / width) <= LAST_OF_BAND
        last = last.union(rest.where(ready))
        at = rest.where(~ready)
        left = 0 if left <= LAST_OF_BAND else -(-left // FAN)
        level, width = level + 1, width * FAN
    root = last.groupBy(*keys).agg(settle(F.collect_list("m"), kind, level, seed).alias("s"))
    ended = shared.written(root.select(*keys, repaired(F.col("s.open"), F.col("s.done"), kind).alias("ms")), "root")
    return out.union(settled(ended.select(*keys, F.explode("ms").alias("m"))))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """A row per row of ``docs``: id, h1 and h2 (hashes of all its columns), source, size, source_size, target, copies."""
    planned = shared.written(plan(docs, **settings), "plan")
    each = shared.expanded(planned, F.col("n"), planned.agg(F.max("n")).first()[0] or 0)
    return each.select("id", "h1", "h2", "source", "source_size", "target", "size", (F.col("whole") + (F.col("nth") <= F.col("more")).cast("long")).alias("copies"))


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    total = F.col("n") * F.col("whole") + F.col("more")
    taken = shared.written(plan(docs, **settings).select("h1", "h2", "n", total.alias("copies")).where("copies > 0"), "taken")
    found = shared.rows_with(docs, taken, "copies")
    return shared.expanded(found, F.col("copies"), taken.agg(F.max("copies")).first()[0] or 0).select("row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes each of the ``documents``, in words."""
    found = mix(shared.table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources' sizes and targets that op6 mixes ``documents`` to."""
    return op6_mixing(spark, sf_dir).select("doc_id", "size", "source_size", "target")


TARGETS_ORACLE = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(size) AS BIGINT) * {MOST_COPIES} AS most, {list(WEIGHTS)}[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS weight FROM d GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS place FROM per),
filled AS (SELECT *, sum(source_size) OVER () - coalesce(sum(most) OVER w, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS weights FROM placed WINDOW w AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
free AS (SELECT min(place) AS place, arg_min(rest, place) AS rest, arg_min(weights, place) AS weights FROM filled WHERE rest * weight < most * weights)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, f.source_size, CAST(CASE WHEN free.place IS NULL OR f.place < free.place THEN f.most ELSE CAST(free.rest * f.weight AS DOUBLE) / free.weights END AS DOUBLE) AS target
FROM d JOIN filled AS f ON d.source IS NOT DISTINCT FROM f.source, free
"""

"""The queries of the engine on the driver's tables, and the same in SQL.

Tables are shredded by their keys: ``customer.c-12.c_name``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waypost import render
from waypost.clients.client import Client
from waypost.clients.server import Server
from waypost.errors import WaypostError
from waypost.functions import values as V
from waypost.operators import access, analysis, entity, scan, where
from waypost.operators.value_index import ValueIndex
from waypost.operators.where import Condition
from waypost.sources import log as changes
from waypost.sources import shred as S
from waypost.store import EndpointStore
from waypost.streaming import subscribe

#: Table: (letter of its entities, key columns).
KEYS = {
    "region": ("r", ["r_regionkey"]), "nation": ("n", ["n_nationkey"]), "customer": ("c", ["c_custkey"]), "supplier": ("s", ["s_suppkey"]), "part": ("p", ["p_partkey"]), "orders": ("o", ["o_orderkey"]),
    "events": ("e", ["event_id"]), "embeddings": ("v", ["vec_id"]), "labels": ("d", ["doc_id"]), "benchmark": ("b", ["item_id"]), "pages": ("p", ["page_id"]), "conversations": ("t", ["conv_id", "turn"]),
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder for a store, in the one that all executors share; a temporary one only where all runs in one process (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="waypost-")
    return f"{at.rstrip('/')}/waypost/{label}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def endpoints(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    letter, keys = KEYS[name]
    return S.shred(table(spark, sf_dir, name), name, S.keyed(letter, *keys), columns)


def query(sql: str | None = None):
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def cells(table_name: str, key: str, letter: str, columns: dict[str, str]) -> str:
    """SQL of a table's cells: path, vtype, v_int, v_float, v_str; ``columns``: name to type tag."""
    parts = []
    for c, tag in columns.items():
        held = {"integer": f"CAST({c} AS BIGINT), NULL::DOUBLE, NULL::VARCHAR", "float": f"NULL::BIGINT, CAST({c} AS DOUBLE), NULL::VARCHAR", "string": f"NULL::BIGINT, NULL::DOUBLE, CAST({c} AS VARCHAR)"}[tag]
        parts.append(f"SELECT '{table_name}.{letter}-' || {key} || '.{c}' AS path, '{tag}' AS vtype, {held} FROM {table_name}")
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) AS t(path, vtype, v_int, v_float, v_str)"


TYPED = ["path", "vtype", "v_int", "v_float", "v_str"]
CUSTOMER = {"c_custkey": "integer", "c_name": "string", "c_nationkey": "integer", "c_acctbal": "float", "c_mktsegment": "string"}
SUPPLIER = {"s_suppkey": "integer", "s_name": "string", "s_nationkey": "integer", "s_acctbal": "float"}
CUSTOMER_CELLS = cells("customer", "c_custkey", "c", CUSTOMER)
SUPPLIER_CELLS = cells("supplier", "s_suppkey", "s", SUPPLIER)


@query(cells("region", "r_regionkey", "r", {"r_regionkey": "integer", "r_name": "string"}))
def shred_region(spark, sf_dir):
    return endpoints(spark, sf_dir, "region").select(*TYPED)


@query("SELECT 'embeddings.v-' || vec_id || '.embedding.[' || (i - 1) || ']' AS path, CAST(embedding[i] AS DOUBLE) AS v_float FROM embeddings, LATERAL unnest(range(1, len(embedding) + 1)) AS r(i)")
def shred_arrays(spark, sf_dir):
    return endpoints(spark, sf_dir, "embeddings", ["embedding"]).select("path", "v_float")


@query(cells("orders", "o_orderkey", "o", {"o_orderkey": "integer", "o_custkey": "integer", "o_orderstatus": "string", "o_totalprice": "float", "o_orderpriority": "string"}) + " UNION ALL SELECT 'orders.o-' || o_orderkey || '.o_orderdate', 'string', NULL, NULL, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') FROM orders")
def shred_orders(spark, sf_dir):
    return endpoints(spark, sf_dir, "orders").select(*TYPED)


@query(f"SELECT path, v_str FROM ({CUSTOMER_CELLS}) WHERE path = 'customer.c-12.c_name'")
def get_endpoint(spark, sf_dir):
    return scan.get(endpoints(spark, sf_dir, "customer"), "customer.c-12.c_name").select("path", "v_str")


@query(f"SELECT count(*) > 0 AS there, (SELECT count(*) > 0 FROM ({CUSTOMER_CELLS}) WHERE path = 'customer.c-12') AS inner_node FROM ({CUSTOMER_CELLS}) WHERE path = 'customer.c-12.c_name'")
def exists_endpoint(spark, sf_dir):
    ep = endpoints(spark, sf_dir, "customer")
    return spark.createDataFrame([(scan.exists(ep, "customer.c-12.c_name"), scan.exists(ep, "customer.c-12"))], "there boolean, inner_node boolean")


@query(f"SELECT path FROM ({CUSTOMER_CELLS}) WHERE path LIKE 'customer.c-1.%'")
def list_prefix_customer(spark, sf_dir):
    return scan.list_prefix(endpoints(spark, sf_dir, "customer"), "customer.c-1")


@query(f"SELECT * FROM ({SUPPLIER_CELLS}) WHERE path LIKE 'supplier.%.s_name'")
def get_prefix_wildcard(spark, sf_dir):
    return scan.get_prefix(endpoints(spark, sf_dir, "supplier"), "supplier.*.s_name").select(*TYPED)


@query("SELECT 'customer.c-' || c_custkey || '.c_mktsegment' AS path, c_mktsegment AS v_str FROM customer")
def wildcard_single(spark, sf_dir):
    return scan.query(endpoints(spark, sf_dir, "customer"), "customer.*.c_mktsegment").select("path", "v_str")


@query("SELECT 'customer.c-' || c_custkey || '.c_name' AS path, c_name AS v_str FROM customer")
def wildcard_double_star(spark, sf_dir):
    both = endpoints(spark, sf_dir, "customer").union(endpoints(spark, sf_dir, "supplier"))
    return scan.query(both, "customer.**.c_name").select("path", "v_str")


@query(f"SELECT path FROM ({CUSTOMER_CELLS}) WHERE path LIKE '%.c_name' UNION ALL SELECT path FROM ({SUPPLIER_CELLS}) WHERE path LIKE '%.c_name'")
def wildcard_double_star_compat(spark, sf_dir):
    both = endpoints(spark, sf_dir, "customer").union(endpoints(spark, sf_dir, "supplier"))
    return scan.query(both, "supplier.**.c_name", compat=True).select("path")


@query("SELECT 'nation.n-' || n_nationkey || '.n_name' AS path, n_name AS v_str FROM nation")
def wildcard_multi_position(spark, sf_dir):
    both = endpoints(spark, sf_dir, "nation").union(endpoints(spark, sf_dir, "region"))
    return scan.query(both, "*.*.n_name").select("path", "v_str")


@query("SELECT 'embeddings.v-' || vec_id || '.embedding.[0]' AS path, CAST(embedding[1] AS DOUBLE) AS v_float FROM embeddings")
def wildcard_array_index(spark, sf_dir):
    return scan.query(endpoints(spark, sf_dir, "embeddings"), "embeddings.**.embedding[0]").select("path", "v_float")


@query(f"SELECT path, v_float FROM ({CUSTOMER_CELLS}) WHERE path = 'customer.c-7.c_acctbal'")
def query_exact(spark, sf_dir):
    return scan.query(endpoints(spark, sf_dir, "customer"), "customer.c-7.c_acctbal").select("path", "v_float")


@query("SELECT 5 * (SELECT count(*) FROM customer) + 4 * (SELECT count(*) FROM supplier) AS n")
def count_all(spark, sf_dir):
    return scan.count(endpoints(spark, sf_dir, "customer").union(endpoints(spark, sf_dir, "supplier")))


@query("SELECT 4 * count(*) AS n FROM supplier")
def count_prefix(spark, sf_dir):
    return scan.count_prefix(endpoints(spark, sf_dir, "customer").union(endpoints(spark, sf_dir, "supplier")), "supplier")


@query("SELECT 'embeddings.v-' || vec_id || '.embedding.[3]' AS path, 4 AS length, 'v-' || vec_id AS second, 3 AS last_index FROM embeddings")
def path_inspection(spark, sf_dir):
    ep = scan.query(endpoints(spark, sf_dir, "embeddings"), "embeddings.*.embedding.[3]")
    return ep.select("path", F.size("segments").alias("length"), F.get("segments", F.lit(1)).alias("second"), F.regexp_extract(F.element_at("segments", -1), r"^\[(\d+)\]$", 1).cast("int").alias("last_index"))


def _ids(spark, sf_dir, name, tree, compat=False):
    return where.matching_entities(endpoints(spark, sf_dir, name), (name,), tree, compat).select("id")


@query("SELECT 'c-' || c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING'")
def filter_eq(spark, sf_dir):
    return _ids(spark, sf_dir, "customer", Condition(("c_mktsegment",), "==", "BUILDING"))


@query("SELECT 'c-' || c_custkey AS id FROM customer WHERE c_mktsegment <> 'BUILDING'")
def filter_neq(spark, sf_dir):
    return _ids(spark, sf_dir, "customer", Condition(("c_mktsegment",), "!=", "BUILDING"))


@query("SELECT 'p-' || p_partkey AS entity_id, p_name, p_size FROM part WHERE p_size < 10")
def filter_lt_flipped(spark, sf_dir):
    store = EndpointStore(spark, endpoints(spark, sf_dir, "part"))
    rows = store.ql("{ return part where 10 > their.p_size }")
    return rows.select(F.col("id").alias("entity_id"), F.get_json_object("json", "$.p_name").alias("p_name"), F.get_json_object("json", "$.p_size").cast("int").alias("p_size"))


@query("SELECT 'p-' || p_partkey AS id FROM part WHERE p_size BETWEEN 5 AND 10")
def filter_le_ge(spark, sf_dir):
    return _ids(spark, sf_dir, "part", ("and", [Condition(("p_size",), ">=", 5), Condition(("p_size",), "<=", 10)]))


@query("SELECT 'o-' || o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000")
def filter_and(spark, sf_dir):
    return _ids(spark, sf_dir, "orders", ("and", [Condition(("o_orderstatus",), "==", "F"), Condition(("o_totalprice",), ">", 200000)]))


@query("SELECT 'o-' || o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' OR o_totalprice > 200000")
def filter_or(spark, sf_dir):
    return _ids(spark, sf_dir, "orders", ("or", [Condition(("o_orderstatus",), "==", "F"), Condition(("o_totalprice",), ">", 200000)]))


@query("SELECT 'o-' || o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000")
def filter_or_compat(spark, sf_dir):
    return _ids(spark, sf_dir, "orders", ("or", [Condition(("o_orderstatus",), "==", "F"), Condition(("o_totalprice",), ">", 200000)]), compat=True)


@query("SELECT 'o-' || o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' OR (o_orderstatus = 'F' AND o_totalprice <= 100000.5)")
def filter_precedence(spark, sf_dir):
    store = EndpointStore(spark, endpoints(spark, sf_dir, "orders"))
    return store.ql('{ return orders where their.o_orderstatus == "O" || their.o_orderstatus == "F" && their.o_totalprice <= 100000.5 }').select("id")


@query("SELECT 'o-' || o_orderkey AS id FROM orders WHERE o_orderpriority < '3'")
def filter_string_range(spark, sf_dir):
    return _ids(spark, sf_dir, "orders", Condition(("o_orderpriority",), "<", "3"))


@query("SELECT 'c-' || c_custkey AS id FROM customer WHERE c_acctbal > 1000")
def filter_int_vs_float(spark, sf_dir):
    return _ids(spark, sf_dir, "customer", ("and", [Condition(("c_acctbal",), ">", 1000), Condition(("c_acctbal",), "!=", 5)]))


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def entity_wide(spark, sf_dir):
    placed = entity.with_entity(endpoints(spark, sf_dir, "customer"), ("customer",))
    wide = entity.wide(placed, {"c_custkey": ("c_custkey", "v_int"), "c_name": ("c_name", "v_str"), "c_nationkey": ("c_nationkey", "v_int"), "c_acctbal": ("c_acctbal", "v_float"), "c_mktsegment": ("c_mktsegment", "v_str")})
    return wide.select("c_custkey", "c_name", F.col("c_nationkey").cast("int").alias("c_nationkey"), "c_acctbal", "c_mktsegment")


@query("SELECT 'n-' || n_nationkey AS id, 3 AS n_attributes, n_name AS name FROM nation")
def entity_map(spark, sf_dir):
    found = entity.maps(entity.with_entity(endpoints(spark, sf_dir, "nation"), ("nation",)))
    return found.select("id", F.size("attributes").alias("n_attributes"), F.col("attributes")["n_name"]["v_str"].alias("name"))


@query("""SELECT 'nation.n-' || n_nationkey AS entity, '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS json FROM nation""")
def entity_json(spark, sf_dir):
    return entity.json(entity.with_entity(endpoints(spark, sf_dir, "nation"), ("nation",))).select("entity", "json")


@query("""SELECT 'nation.n-' || n_nationkey AS entity, '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS json FROM nation""")
def entity_json_flat(spark, sf_dir):
    return entity.flat_json(entity.with_entity(endpoints(spark, sf_dir, "nation"), ("nation",))).select("entity", "json")


@query("SELECT 'v-' || vec_id AS id, len(embedding) AS n_items, CAST(embedding[1] AS DOUBLE) AS first_item, CAST(embedding[len(embedding)] AS DOUBLE) AS last_item FROM embeddings")
def entity_array(spark, sf_dir):
    found = entity.arrays(entity.with_entity(endpoints(spark, sf_dir, "embeddings"), ("embeddings",)), "embedding", "v_float")
    return found.select("id", F.size("items").cast("long").alias("n_items"), F.get("items", F.lit(0)).alias("first_item"), F.element_at("items", -1).alias("last_item"))


@query("SELECT 'customer.c-5.c_name' AS path, 'someone' AS v_str UNION ALL SELECT 'customer.c-' || c_custkey || '.c_name', c_name FROM customer WHERE c_custkey <> 5")
def assign_then_read(spark, sf_dir):
    store = EndpointStore(spark, endpoints(spark, sf_dir, "customer"))
    return store.ql('{ customer.c-5.c_name = "someone"; return customer.*.c_name }').select("path", "v_str")


@query("SELECT 5 * count(*) - 1 AS n FROM customer")
def delete_then_count(spark, sf_dir):
    store = EndpointStore(spark, endpoints(spark, sf_dir, "customer"))
    return spark.createDataFrame([(store.ql('{ delete customer.c-5.c_name; return count("customer") }'),)], "n long")


def _event_log(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events").selectExpr("concat('users.u-', user_id, '.last_event') AS path", "event_type AS v_str", "event_id AS seq", "CAST(ts AS TIMESTAMP) AS ts", "event_type = 'error' AS deleted")
    named = events.selectExpr("path", "'string' AS vtype", "CAST(NULL AS BOOLEAN) AS v_bool", "CAST(NULL AS BIGINT) AS v_int", "CAST(NULL AS DOUBLE) AS v_float", "v_str", "CAST(NULL AS BINARY) AS v_bin", "CAST(NULL AS STRING) AS v_mime", "CAST(NULL AS STRING) AS v_ref", "seq", "deleted", "ts")
    segments = F.split("path", r"\.")
    return named.select(F.get(segments, F.lit(0)).alias("root"), F.size(segments).alias("depth"), "path", segments.alias("segments"), *V.VALUE_COLUMNS, "seq", "deleted", "ts")


@query("SELECT 'users.u-' || user_id || '.last_event' AS path, max_by(event_type, event_id) AS v_str FROM events GROUP BY user_id HAVING max_by(event_type, event_id) <> 'error'")
def latest_state(spark, sf_dir):
    return changes.current(_event_log(spark, sf_dir)).select("path", "v_str")


@query("SELECT 'users.u-' || user_id || '.last_event' AS path, max_by(event_type, event_id) AS v_str FROM events WHERE event_id <= (SELECT max(event_id) // 2 FROM events) GROUP BY user_id HAVING max_by(event_type, event_id) <> 'error'")
def snapshot_state(spark, sf_dir):
    log = _event_log(spark, sf_dir)
    half = log.agg(F.expr("max(seq) div 2")).first()[0]
    return changes.current(log, until_seq=half).select("path", "v_str")


@query("SELECT event_id AS seq, event_type AS v_str FROM events WHERE user_id = (SELECT min(user_id) FROM events)")
def history_of_path(spark, sf_dir):
    log = _event_log(spark, sf_dir)
    first = table(spark, sf_dir, "events").agg(F.min("user_id")).first()[0]
    return changes.history(log, f"users.u-{first}.last_event").select("seq", "v_str")


@query("SELECT count(*) AS total_operations, count(*) FILTER (event_type <> 'error') AS total_adds, count(*) FILTER (event_type = 'error') AS total_removes FROM events")
def log_stats(spark, sf_dir):
    return changes.stats(_event_log(spark, sf_dir))


@query("SELECT 'customer.c-' || c_custkey || '.c_mktsegment' AS path FROM customer WHERE c_mktsegment = 'BUILDING'")
def find_by_value(spark, sf_dir):
    return scan.find_by_value(endpoints(spark, sf_dir, "customer"), "BUILDING").select("path")


@query(f"SELECT path FROM ({CUSTOMER_CELLS}) WHERE coalesce(v_float, v_int) >= 9000")
def find_by_condition(spark, sf_dir):
    return scan.find_by_condition(endpoints(spark, sf_dir, "customer"), ">=", 9000).select("path")


@query(f"SELECT split_part(path, '.', 1) AS root, vtype, count(*) AS n FROM ({CUSTOMER_CELLS} UNION ALL {SUPPLIER_CELLS}) GROUP BY ALL")
def type_census(spark, sf_dir):
    return scan.type_census(endpoints(spark, sf_dir, "customer").union(endpoints(spark, sf_dir, "supplier")))


@query("SELECT 'events.e-' || event_id || '.props' AS path, CASE WHEN props IS NULL THEN 'null' ELSE 'string' END AS vtype, props AS v_str FROM events")
def json_decode(spark, sf_dir):
    told = table(spark, sf_dir, "events").selectExpr("concat('events.e-', event_id, '.props') AS path", "props AS value")
    return S.from_json_text(told).select("path", "vtype", "v_str")


@query("SELECT 'region.r-' || r_regionkey || '.r_name' AS path, '\"' || r_name || '\"' AS json FROM region UNION ALL SELECT 'region.r-' || r_regionkey || '.r_regionkey', CAST(r_regionkey AS VARCHAR) FROM region")
def json_encode(spark, sf_dir):
    return endpoints(spark, sf_dir, "region").select("path", V.json_column().alias("json"))


@query("""SELECT 'c-' || c_custkey AS id, '{"name":"' || c_name || '","where":{"nation":' || c_nationkey || '}}' AS json FROM customer""")
def shape_entities(spark, sf_dir):
    store = EndpointStore(spark, endpoints(spark, sf_dir, "customer"))
    return store.ql("{ return customer.*.{ name: c_name, where: { nation: c_nationkey } } }").select("id", "json")


@query("""SELECT 'v-' || vec_id AS id, round(list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))), 6) AS similarity
FROM (SELECT vec_id, embedding::DOUBLE[] AS e, (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1) AS q FROM embeddings) ORDER BY 2 DESC, 1 LIMIT 10""")
def vector_search(spark, sf_dir):
    first = [float(x) for x in table(spark, sf_dir, "embeddings").orderBy("vec_id").first()["embedding"]]
    found = analysis.vector_search(endpoints(spark, sf_dir, "embeddings", ["embedding"]), "embeddings", "embedding", first, 10)
    return found.select("id", F.round("similarity", 6).alias("similarity"))


def _orders_with_references(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders").selectExpr("concat('orders.o-', o_orderkey, '.customer') AS path", "concat('customer.c-', o_custkey) AS ref")
    told = orders.select("path", F.to_json(F.struct(F.lit("reference").alias("type"), F.col("ref").alias("path"))).alias("value"))
    return S.from_json_text(told)


@query("SELECT 'orders.o-' || o_orderkey || '.customer' AS from_path, 'customer.c-' || c_custkey || '.c_name' AS path, c_name AS v_str FROM orders JOIN customer ON o_custkey = c_custkey")
def dereference(spark, sf_dir):
    names = scan.query(endpoints(spark, sf_dir, "customer"), "customer.*.c_name")
    return scan.dereference(_orders_with_references(spark, sf_dir), names).select("from_path", "path", "v_str")


@query("SELECT 'orders.o-' || o_orderkey || '.customer' AS path, 'customer.c-' || o_custkey AS v_ref FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)")
def dangling_references(spark, sf_dir):
    some = S.shred(table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0"), "customer", S.keyed("c", "c_custkey"), ["c_name"])
    return analysis.dangling(_orders_with_references(spark, sf_dir).union(some), "orders.*.customer")


@query("SELECT 'string' AS vtype, c_mktsegment AS v_str, count(*) AS n FROM customer GROUP BY c_mktsegment HAVING count(*) > 1")
def unique_violations(spark, sf_dir):
    return analysis.duplicates(endpoints(spark, sf_dir, "customer"), "customer.*.c_mktsegment").select("vtype", "v_str", "n")


@query("SELECT 'customer.c-' || c_custkey || '.c_acctbal' AS path, 'float' AS vtype FROM customer")
def type_violations(spark, sf_dir):
    return analysis.type_violations(endpoints(spark, sf_dir, "customer"), "customer.*.c_acctbal", "integer", "null")


@query("SELECT count(*) AS n, round(sum(c_acctbal), 2) AS total, round(avg(c_acctbal), 4) AS mean, min(c_acctbal) AS least, max(c_acctbal) AS greatest FROM customer")
def attribute_stats(spark, sf_dir):
    found = analysis.attribute_stats(endpoints(spark, sf_dir, "customer"), "customer.*.c_acctbal")
    return found.select("n", F.round("total", 2).alias("total"), F.round("mean", 4).alias("mean"), "least", "greatest")


@query("SELECT 'c-' || c_custkey AS id, c_acctbal AS value FROM customer ORDER BY c_acctbal DESC, 1 LIMIT 20")
def sorted_entities(spark, sf_dir):
    placed = entity.with_entity(endpoints(spark, sf_dir, "customer"), ("customer",))
    return analysis.sorted_by(placed, "c_acctbal", "v_float", 20, descending=True)


@query("SELECT 'c-' || c_custkey AS id FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def in_list(spark, sf_dir):
    placed = entity.with_entity(endpoints(spark, sf_dir, "customer"), ("customer",))
    return analysis.members(placed, "c_mktsegment", ["BUILDING", "MACHINERY"])


TWO_AWAY = """WITH links AS (SELECT DISTINCT 'n-' || n_nationkey AS id, 'n-' || ((n_nationkey + k) % 25) AS other FROM nation, (VALUES (1), (3)) AS s(k)),
two AS (SELECT a.id, b.other, count(*) AS n FROM links a JOIN links b ON a.other = b.id WHERE a.id <> b.other GROUP BY ALL)
SELECT * FROM two WHERE NOT EXISTS (SELECT 1 FROM links WHERE links.id = two.id AND links.other = two.other)"""


def _friends(spark, sf_dir) -> DataFrame:
    steps = F.explode(F.array(F.lit(1), F.lit(3))).alias("k")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", steps).selectExpr("concat('nation.n-', n_nationkey, '.friends.[', k, ']') AS path", "concat('nation.n-', (n_nationkey + k) % 25) AS ref")
    told = rows.select("path", F.to_json(F.struct(F.lit("reference").alias("type"), F.col("ref").alias("path"))).alias("value"))
    return S.from_json_text(told)


@query(TWO_AWAY)
def related_of_related(spark, sf_dir):
    return analysis.related_of_related(analysis.related(_friends(spark, sf_dir), "nation", "friends"))


@query(f"""SELECT '{{"id":"' || id || '","other":"' || other || '","n":' || n || '}}' AS json FROM ({TWO_AWAY})""")
def ql_related(spark, sf_dir):
    return EndpointStore(spark, _friends(spark, sf_dir)).ql("{ return related_of_related(nation.*.friends) }").select("json")


@query("SELECT 'part.p-' || p_partkey || '.p_size' AS path, CAST(p_size AS BIGINT) AS v_int FROM part WHERE CAST(p_partkey AS VARCHAR) LIKE '%7%' AND p_size > 40")
def endpoints_where(spark, sf_dir):
    found = scan.query(endpoints(spark, sf_dir, "part"), "part.*.p_size")
    return found.where(F.contains(F.get("segments", F.lit(1)), F.lit("7")) & (F.col("v_int") > 40)).select("path", "v_int")


@query("SELECT 5 * count(*) AS by_text, count(*) AS by_pattern FROM customer")
def ql_count(spark, sf_dir):
    store = EndpointStore(spark, endpoints(spark, sf_dir, "customer"))
    return spark.createDataFrame([(store.ql('{ return count("customer") }'), store.ql("{ return count(customer.*.c_name) }"))], "by_text long, by_pattern long")


@query("SELECT true AS now, true AS uuid, true AS fresh")
def ql_now_and_uuid(spark, sf_dir):
    store = EndpointStore(spark)
    now, one, two = (store.ql("{ %s return %s }" % x) for x in (("a.now = now();", "a.now"), ("", "uuid()"), ("", "uuid()")))
    form = r"^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
    return spark.createDataFrame([(now, one, two)], "n string, u string, w string").select(F.to_timestamp("n").isNotNull().alias("now"), F.col("u").rlike(form).alias("uuid"), (F.col("u") != F.col("w")).alias("fresh"))


# shapes of entities


def _boxes(spark, sf_dir) -> DataFrame:
    """Parts as nested entities: objects, an array, an array of objects."""
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("name"), F.struct(F.col("p_type").alias("kind"), F.struct(size.alias("deep"), (size + 1).alias("wide")).alias("inner")).alias("box"),
        F.array(size, size * 2).alias("marks"), F.array(F.struct(F.lit(True).alias("ok")), F.struct(F.lit(None).cast("boolean").alias("ok"))).alias("checks"),
    )
    return S.shred(rows, "box", S.keyed("b", "p_partkey"), ["name", "box", "marks", "checks"])


BOX = """'{"box":{"inner":{"deep":' || p_size || ',"wide":' || (p_size + 1) || '},"kind":"' || p_type || '"},"checks":[{"ok":true},{"ok":null}],"marks":[' || p_size || ',' || (2 * p_size) || '],"name":"' || p_name || '"}'"""


@query(f"SELECT 'box.b-' || p_partkey AS entity, {BOX} AS json FROM part")
def entity_json_nested(spark, sf_dir):
    return entity.json(entity.with_entity(_boxes(spark, sf_dir), ("box",))).select("entity", "json")


@query(f"SELECT {BOX} AS json, p_size + 1 AS wide FROM part WHERE p_partkey = 7")
def path_expression(spark, sf_dir):
    store = EndpointStore(spark, _boxes(spark, sf_dir))
    return spark.createDataFrame([(render.json_text(store.ql("{ return box.b-7 }")), store.ql("{ return box.b-7.box.inner.wide }"))], "json string, wide int")


@query(f"SELECT 'b-' || p_partkey AS id, {BOX} AS json FROM part WHERE p_size + 1 > 40 AND p_type = 'ECONOMY'")
def filter_nested_attributes(spark, sf_dir):
    return EndpointStore(spark, _boxes(spark, sf_dir)).ql('{ return box where their.box.inner.wide > 40 && their.box.kind == "ECONOMY" }').select("id", "json")


@query(f"SELECT {BOX} AS stored FROM part WHERE p_partkey = 7")
def entity_as_value(spark, sf_dir):
    store = EndpointStore(spark, _boxes(spark, sf_dir))
    return spark.createDataFrame([(store.ql("{ copy.of = box.b-7; return copy.of }"),)], "stored string")


@query("SELECT 'o-' || r_regionkey AS id, r_regionkey % 2 = 0 AS clash FROM region")
def conflicting_shapes(spark, sf_dir):
    """A scalar where an object is, in every other entity."""
    key = "concat('x.o-', r_regionkey, '.a')"
    told = table(spark, sf_dir, "region").selectExpr(f"explode(if(r_regionkey % 2 = 0, array({key}, concat({key}, '.b')), array(concat({key}, '1'), concat({key}, '.b')))) AS path", "'1' AS value")
    placed = entity.with_entity(S.from_json_text(told), ("x",))
    return placed.groupBy("id").agg(entity.conflict(F.collect_list("rel")).alias("clash"))


@query("SELECT 'scalar in an object' AS shape, true AS fails UNION ALL SELECT 'endpoint above others', true UNION ALL SELECT 'object and array', true UNION ALL SELECT 'plain', false")
def conflicts_fail(spark, sf_dir):
    shapes = {"scalar in an object": ["x.e.a", "x.e.a.b"], "endpoint above others": ["x.e", "x.e.a"], "object and array": ["x.e.a", "x.e.[0]"], "plain": ["x.e.a", "x.e.b.[0]"]}

    def fails(paths) -> bool:
        try:
            EndpointStore.in_memory(spark, dict.fromkeys(paths, 1)).get_entity("x.e")
        except WaypostError:
            return True
        return False

    return spark.createDataFrame([(k, fails(v)) for k, v in shapes.items()], "shape string, fails boolean")


# the language


@query("SELECT * FROM (VALUES ('a.f', 'float', '2.5'), ('a.i', 'integer', '5'), ('a.n', 'null', 'null'), ('a.no', 'boolean', 'false'), ('a.s', 'string', '\"x\"'), ('a.yes', 'boolean', 'true')) AS t(path, vtype, json)")
def literal_types(spark, sf_dir):
    store = EndpointStore(spark)
    return store.ql('{ a.f = 2.5; a.i = 5.0; a.n = null; a.no = false; a.s = "x"; a.yes = true; return a.* }').select("path", "vtype", V.json_column().alias("json"))


@query("SELECT 'p-' || p_partkey AS id FROM part WHERE p_size > 25 AND p_size % 2 = 0")
def filter_boolean_and_null(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size > 25 AS big", "nullif(p_size, if(p_size % 2 = 0, p_size, -1)) AS odd")
    return EndpointStore(spark, S.shred(rows, "part", S.keyed("p", "p_partkey"), ["big", "odd"])).ql("{ return part where their.big == true && null == their.odd }").select("id")


@query("""SELECT '[' || string_agg('"{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}"', ', ' ORDER BY 'nation.n-' || n_nationkey) || ']' AS text FROM nation WHERE n_regionkey = 1""")
def filter_compat_text(spark, sf_dir):
    store = EndpointStore(spark, endpoints(spark, sf_dir, "nation"), compat=True)
    return spark.createDataFrame([(store.ql("{ return nation where their.n_regionkey == 1 }"),)], "text string")


@query("SELECT c_name AS name FROM customer WHERE c_custkey = 3")
def comments_and_spaces(spark, sf_dir):
    store = EndpointStore(spark, endpoints(spark, sf_dir, "customer"))
    return spark.createDataFrame([(store.ql("{ // a line\n /* and\n more */ return\n customer . c-3 . c_name /**/ }"),)], "name string")


BAD = {
    "base is no path": '{ return "x" where their.a == 1 }', "their with their": "{ return x where their.a == their.b }", "their outside": "{ return their.a }", "unknown function": "{ return size(x) }", "their without attribute": "{ return x where their == 1 }",
    "no order of booleans": "{ return x where their.a < true }", "no semicolon": "{ a.b = 1 return a.b }", "count of two": "{ return count(a, b) }", "wildcard stored": "{ a.* = 1; }", "nothing there": "{ return no.such.path }", "nothing to delete": "{ delete no.such.path; }",
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS query, '{'NotFound' if k.startswith('nothing') else 'PathError' if k == 'wildcard stored' else 'InvalidOperation'}' AS error" for k in BAD))
def rejected_queries(spark, sf_dir):
    def error(text: str) -> str:
        try:
            EndpointStore(spark).ql(text)
        except WaypostError as e:
            return type(e).__name__
        return "none"

    return spark.createDataFrame([(k, error(text)) for k, text in BAD.items()], "query string, error string")


@query("SELECT 0 AS n, 5 * count(*) AS everything FROM customer")
def empty_pattern(spark, sf_dir):
    ep = endpoints(spark, sf_dir, "customer")
    return scan.count(scan.query(ep, "")).crossJoin(scan.count(scan.get_prefix(ep, "")).withColumnRenamed("n", "everything"))  # a row each


@query(f"SELECT path FROM ({CUSTOMER_CELLS}) WHERE path LIKE '%.c_acctbal' UNION ALL SELECT path FROM ({SUPPLIER_CELLS}) WHERE path LIKE '%.c_acctbal'")
def wildcard_suffix(spark, sf_dir):
    return scan.query(endpoints(spark, sf_dir, "customer").union(endpoints(spark, sf_dir, "supplier")), "**.c_acctbal").select("path")


@query("SELECT 'c-' || c_custkey AS id FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey = (SELECT c_nationkey + 1 FROM customer WHERE c_custkey = 3)")
def ql_in_and_variables(spark, sf_dir):
    store = EndpointStore(spark, endpoints(spark, sf_dir, "customer"))
    return store.ql('{ let who = customer.c-3; let next = who.c_nationkey + 1; return customer where their.c_mktsegment in ["BUILDING", "MACHINERY"] && their.c_nationkey == next }').select("id")


@query("SELECT 'customer.n-7.name' AS path, 'new' AS v_str, NULL AS v_int UNION ALL SELECT 'customer.n-7.profile.size', NULL, 3")
def ql_batch(spark, sf_dir):
    store = EndpointStore(spark, endpoints(spark, sf_dir, "customer"))
    return store.ql('{ let id = "n-" + "7"; batch(customer[id]) { set ["name"] = "new" set ["profile.size"] = 2 + 1; } return customer.n-7.** }').select("path", "v_str", "v_int")


@query("SELECT 'part.p-' || p_partkey || '.p_size' AS path, CAST(p_size AS BIGINT) AS v_int FROM part WHERE CAST(p_partkey AS VARCHAR) LIKE '%7%' AND p_size > 40")
def ql_endpoints_where(spark, sf_dir):
    return EndpointStore(spark, endpoints(spark, sf_dir, "part")).ql('{ return endpoints(part.*.p_size) where path.includes("7") && value > 40 }').select("path", "v_int")


@query("SELECT round(sum(c_acctbal), 2) AS total, round(avg(c_acctbal), 4) AS mean, min(c_acctbal) AS least, max(c_acctbal) - min(c_acctbal) AS spread FROM customer")
def ql_sums(spark, sf_dir):
    store = EndpointStore(spark, endpoints(spark, sf_dir, "customer"))
    total, mean, least, spread = (store.ql("{ return %s }" % x) for x in ("sum(customer.*.c_acctbal)", "avg(customer.*.c_acctbal)", "min(customer.*.c_acctbal)", "max(customer.*.c_acctbal) - min(customer.*.c_acctbal)"))
    return spark.createDataFrame([(round(total, 2), round(mean, 4), least, spread)], "total double, mean double, least double, spread double")


@query("SELECT row_number() OVER (ORDER BY c_acctbal DESC, 'c-' || c_custkey) AS nth, 'c-' || c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY nth LIMIT 20")
def ql_sort(spark, sf_dir):
    """A report of the 20 richest of a segment."""
    store = EndpointStore(spark, endpoints(spark, sf_dir, "customer"))
    found = store.ql('{ let found = customer where their.c_mktsegment == "BUILDING"; found = found.sort((a, b) => b.c_acctbal - a.c_acctbal); return found }')
    return found.orderBy("place").limit(20).select(F.row_number().over(Window.orderBy("place")).alias("nth"), "id")  # a window over 20 rows


@query("""SELECT 'v-' || vec_id AS id, round(list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))), 6) AS similarity
FROM (SELECT vec_id, embedding::DOUBLE[] AS e, (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1) AS q FROM embeddings) WHERE similarity >= 0.2 ORDER BY 2 DESC, 1 LIMIT 10""")
def ql_vector_search(spark, sf_dir):
    first = table(spark, sf_dir, "embeddings").agg(F.min("vec_id")).first()[0]
    store = EndpointStore(spark, endpoints(spark, sf_dir, "embeddings", ["embedding"]))
    found = store.ql("{ return vector_search(embeddings.*.embedding, embeddings.v-%d.embedding, limit: 10, min_similarity: 0.2) }" % first)
    return found.select("id", F.round(F.get_json_object("json", "$.similarity").cast("double"), 6).alias("similarity"))


# values


@query("""SELECT 'n.' || n_nationkey || '.' || k AS path, t AS vtype, CASE k WHEN 'a' THEN n_nationkey % 2 = 0 END AS v_bool, CASE k WHEN 'b' THEN n_nationkey - 5 END AS v_int, CASE k WHEN 'c' THEN n_nationkey + 0.5 END AS v_float,
CASE k WHEN 'd' THEN n_name || ' "é"' WHEN 'h' THEN '[1,{"a":2}]' END AS v_str, CASE k WHEN 'f' THEN 'text/plain' END AS v_mime, CASE k WHEN 'f' THEN n_name END AS told, CASE k WHEN 'g' THEN 'nation.n-' || n_nationkey END AS v_ref
FROM nation, (VALUES ('a', 'boolean'), ('b', 'integer'), ('c', 'float'), ('d', 'string'), ('e', 'null'), ('f', 'binary'), ('g', 'reference'), ('h', 'string')) AS x(k, t)""")
def json_decode_types(spark, sf_dir):
    values = {
        "a": "CAST(n_nationkey % 2 = 0 AS STRING)", "b": "CAST(n_nationkey - 5 AS STRING)", "c": "concat(n_nationkey, '.5')", "d": "concat('\"', n_name, ' \\\\\"é\\\\\"\"')", "e": "'null'",
        "f": "to_json(named_struct('type', 'binary', 'data', base64(CAST(n_name AS BINARY)), 'mime', 'text/plain'))", "g": "to_json(named_struct('type', 'reference', 'path', concat('nation.n-', n_nationkey)))", "h": "'[1,{\"a\":2}]'",
    }
    pairs = ", ".join(f"named_struct('path', concat('n.', n_nationkey, '.{k}'), 'value', {v})" for k, v in values.items())
    told = S.from_json_text(table(spark, sf_dir, "nation").selectExpr(f"inline(array({pairs}))"))
    return told.select("path", "vtype", "v_bool", "v_int", "v_float", "v_str", "v_mime", F.col("v_bin").cast("string").alias("told"), "v_ref")


@query(f"SELECT path FROM ({CUSTOMER_CELLS}) WHERE path NOT LIKE '%.c_acctbal' AND path NOT LIKE '%.c_name' OR path = 'customer.c-4.c_name'")
def visible_endpoints(spark, sf_dir):
    rules = [("customer.**", True), ("customer.*.c_acctbal", False), ("customer.*.c_name", False), ("customer.c-4.c_name", True)]
    return access.visible(endpoints(spark, sf_dir, "customer"), rules).select("path")


@query(f"SELECT path, 'value' AS found FROM ({CUSTOMER_CELLS}) WHERE v_str = 'BUILDING' AND path LIKE '%.c_mktsegment' UNION ALL SELECT path, 'order' FROM ({CUSTOMER_CELLS}) WHERE path LIKE '%.c_acctbal' AND v_float < 0")
def value_index_lookup(spark, sf_dir):
    index = ValueIndex(endpoints(spark, sf_dir, "customer"))
    for pattern in ("customer.*.c_mktsegment", "customer.*.c_acctbal", "customer.*.c_name"):
        index.register(pattern)
    index.unregister("customer.*.c_name")
    index.materialize(scratch(spark, "values"))
    return index.find_by_value("BUILDING").select("path", F.lit("value").alias("found")).union(index.find_by_condition("<", 0).select("path", F.lit("order")))


@query("SELECT 0 AS left_over, 1 AS after")
def cleared(spark, sf_dir):
    """Clearing a store in a folder, an index, and writing again."""
    at = scratch(spark, "cleared")
    store, index = EndpointStore.open(spark, at), ValueIndex(endpoints(spark, sf_dir, "customer"))
    store.load(endpoints(spark, sf_dir, "supplier"))
    store.clear()
    index.register("customer.**")
    index.clear()
    left = EndpointStore.open(spark, at).count() + index.rows().count()
    store.set("a.b", 1)
    store.flush()
    return spark.createDataFrame([(left, EndpointStore.open(spark, at).count())], "left_over long, after long")


# the store


CHANGED = "SELECT 'customer.c-' || c_custkey || '.c_name' AS path, CASE WHEN c_custkey = 5 THEN 'someone' ELSE c_name END AS v_str FROM customer WHERE c_custkey <> 6"


def _kept(spark, sf_dir, label: str) -> EndpointStore:
    """A store in a folder: customers' names loaded (change 1), compacted, then changed by changes 2 and 3, compacted, and change 4."""
    at = scratch(spark, label)
    store = EndpointStore.open(spark, at)
    store.load(endpoints(spark, sf_dir, "customer", ["c_name"]))
    store.compact()
    other = EndpointStore.open(spark, at)
    other.set("customer.c-5.c_name", "someone")
    other.delete("customer.c-6.c_name")
    other.flush()
    other.compact()
    store.refresh()
    store.set("added.x.y", 1)
    store.flush()
    return EndpointStore.open(spark, at)


@query("""SELECT '{"seq":1,"deleted":false,"value":"' || c_name || '"}' AS told, 'history' AS kind FROM customer WHERE c_custkey = 5 UNION ALL SELECT '{"seq":2,"deleted":false,"value":"someone"}', 'history' UNION ALL SELECT c_name, 'snapshot' FROM customer WHERE c_custkey = 5""")
def ql_past(spark, sf_dir):
    """History and a snapshot before a compaction, by the language."""
    store = _kept(spark, sf_dir, "past")
    before = spark.createDataFrame([(store.ql("{ return snapshot(customer.c-5.c_name, until: 1) }"), "snapshot")], "told string, kind string")
    return store.ql("{ return history(customer.c-5.c_name) }").select(F.col("json").alias("told"), F.lit("history").alias("kind")).union(before)


@query(f"{CHANGED} UNION ALL SELECT 'added.x.y', NULL")
def persistent_store(spark, sf_dir):
    """Written, flushed, compacted, and opened again."""
    return _kept(spark, sf_dir, "kept").endpoints.select("path", "v_str")


@query(f"SELECT 'customer.c-' || c_custkey || '.c_name' AS path, c_name AS v_str, 1 AS until FROM customer UNION ALL SELECT *, 3 FROM ({CHANGED})")
def snapshot_before_compaction(spark, sf_dir):
    store = _kept(spark, sf_dir, "snapshots")
    return store.snapshot(until_seq=1).select("path", "v_str", F.lit(1).alias("until")).union(store.snapshot(until_seq=3).select("path", "v_str", F.lit(3)))


@query("SELECT 1 AS seq, c_name AS v_str, false AS deleted FROM customer WHERE c_custkey = 5 UNION ALL SELECT 2, 'someone', false")
def history_across_compactions(spark, sf_dir):
    return _kept(spark, sf_dir, "history").history("customer.c-5.c_name").select("seq", "v_str", "deleted")


@query("SELECT c_name AS v_str, 'first' AS writer FROM customer WHERE c_custkey = 5 UNION ALL SELECT 'mine', 'copy' UNION ALL SELECT 'mine', 'mut'")
def facade(spark, sf_dir):
    """A store made from another has its own writes; ``store_mut`` is the store itself."""
    first = EndpointStore(spark, endpoints(spark, sf_dir, "customer"))
    copy = EndpointStore.from_store(first)
    copy.store_mut().set("customer.c-5.c_name", "mine")
    path = "customer.c-5.c_name"
    return spark.createDataFrame([(first.get(path), "first"), (copy.get(path), "copy"), (copy.store_mut().get(path), "mut")], "v_str string, writer string")


@query(f"SELECT path FROM ({CUSTOMER_CELLS}) UNION ALL SELECT path FROM ({SUPPLIER_CELLS})")
def list_everything(spark, sf_dir):
    store = EndpointStore(spark, endpoints(spark, sf_dir, "customer"))
    store.load(endpoints(spark, sf_dir, "supplier"))
    return store.list_prefix()


@query("""SELECT 'ok' AS data, '/health' AS route UNION ALL SELECT c_name, 'get' FROM customer WHERE c_custkey = 5 UNION ALL SELECT 'error: NotFound: customer.no', 'missing' UNION ALL SELECT '9', 'set' UNION ALL SELECT CAST(5 * count(*) + 1 AS VARCHAR), 'list' FROM customer
UNION ALL SELECT CAST(5 * count(*) AS VARCHAR), 'query' FROM customer UNION ALL SELECT 'error: No such route: GET /nowhere', 'route'""")
def http_round_trip(spark, sf_dir):
    """Server and client."""
    with Server(EndpointStore(spark, endpoints(spark, sf_dir, "customer"))) as server:
        client = Client(server.address)

        def told(act) -> str:
            try:
                return str(act())
            except WaypostError as e:
                return f"error: {e}"

        rows = [(told(client.health).lower(), "/health"), (told(lambda: client.get("customer.c-5.c_name")), "get"), (told(lambda: client.get("customer.no")), "missing")]
        client.set("http.x.n", 9)
        rows += [(told(lambda: client.get("http.x.n")), "set"), (told(lambda: len(client.list())), "list"), (told(lambda: client.query('{ return count("customer") }')), "query"), (told(lambda: client.ask("/nowhere")), "route")]
    return spark.createDataFrame(rows, "data string, route string")


@query("""SELECT 'text' AS form, '{' || chr(10) || '  "r_name": "' || r_name || '",' || chr(10) || '  "r_regionkey": ' || r_regionkey || chr(10) || '}' AS text FROM region WHERE r_regionkey = 2
UNION ALL SELECT 'json', '{' || chr(10) || '  "r_name": "' || r_name || '",' || chr(10) || '  "r_regionkey": ' || r_regionkey || chr(10) || '}' FROM region WHERE r_regionkey = 2
UNION ALL SELECT 'paths', 'region.r-2.r_name' || chr(10) || 'region.r-2.r_regionkey' UNION ALL SELECT 'message', 'Error: no'""")
def rendered(spark, sf_dir):
    store = EndpointStore(spark, endpoints(spark, sf_dir, "region"))
    found = store.get_entity("region.r-2")
    paths = [r["path"] for r in store.list_prefix("region.r-2").orderBy("path").collect()]
    return spark.createDataFrame([("text", render.render(found)), ("json", render.render(found, "json")), ("paths", render.render_paths(paths)), ("message", render.render_message("error", "no"))], "form string, text string")


@query("SELECT 'supplier.s-' || s_suppkey || '.s_acctbal' AS path, s_acctbal AS v_float FROM supplier WHERE s_acctbal > 1000")
def subscription(spark, sf_dir):
    """The changes of a pattern as a stream, run until it has caught up."""
    at = scratch(spark, "subscribed")
    EndpointStore.open(spark, at).load(endpoints(spark, sf_dir, "supplier"))
    changed = subscribe.subscribe(spark, at, "supplier.*.s_acctbal", F.col("v_float") > 1000).select("path", "v_float")
    out = scratch(spark, "caught")
    changed.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-at").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("path string, v_float double").parquet(out)


@query("SELECT 'c-' || c_custkey AS id, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 1000")
def flagship(spark, sf_dir):
    store = EndpointStore(spark, endpoints(spark, sf_dir, "customer"))
    found = store.ql('{ return customer where their.c_mktsegment == "BUILDING" && their.c_acctbal > 1000 }')
    return found.select("id", F.get_json_object("json", "$.c_name").alias("name"))


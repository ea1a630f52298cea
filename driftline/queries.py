"""The registered queries of the engine over the test tables, and the same in SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import stats, text
from .operators import evaluate, evolve, joins
from .plans import answers, keys, mutate, relink, schema, validate, workload
from .sources import benchmark, catalog, results

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable], Callable]:
    """Registers a function of (spark, tables) under its name, with its SQL if that can express it."""

    def register(f: Callable[[SparkSession, Tables], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, root: f(spark, Tables(spark, root))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


class Tables(dict):
    """Tables of a folder by name, read when asked for."""

    def __init__(self, spark: SparkSession, root: str):
        super().__init__()
        self.spark, self.root = spark, root

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        return self[name]

    def sql(self, text_: str, **frames: DataFrame) -> DataFrame:
        """Runs SQL whose table names stand in braces."""
        names = {n: self[n] for n in catalog.TABLES if "{" + n + "}" in text_}
        return self.spark.sql(text_, **names, **frames)


def both(name: str, sql: str, spark_sql: str | None = None) -> None:
    """A query of the relational surface, in one text for both engines; table names stand in braces."""
    QUERIES[name] = lambda spark, root: Tables(spark, root).sql(spark_sql or sql)
    ORACLE[name] = sql.replace("{", "").replace("}", "")


# The relational surface.
both("rel_project_concat", "SELECT c_custkey, c_name || ' - ' || c_mktsegment AS label FROM {customer}")
both("rel_filter_eq", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderpriority = '1-URGENT'")
both("rel_filter_range", "SELECT p_partkey, p_size FROM {part} WHERE p_size > 10 AND p_size <= 20 AND p_retailprice < 910 AND p_partkey >= 5")
both("rel_between", "SELECT p_partkey, p_size FROM {part} WHERE p_size BETWEEN 5 AND 15")
both("rel_like_ci", "SELECT p_partkey, p_type FROM {part} WHERE p_type ILIKE '%steel' OR p_name ILIKE 'a%' OR p_brand ILIKE '%#2%'")
both("rel_not_null", "SELECT event_id, event_type, nullif(event_type, 'click') AS kind FROM {events} WHERE nullif(event_type, 'click') IS NOT NULL")
both("rel_text_date", "SELECT o_orderkey, substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10) AS day FROM {orders} WHERE substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10) >= '1995-01-01' AND substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10) < '1996-01-01'", "SELECT o_orderkey, substr(CAST(o_orderdate AS STRING), 1, 10) AS day FROM {orders} WHERE substr(CAST(o_orderdate AS STRING), 1, 10) >= '1995-01-01' AND substr(CAST(o_orderdate AS STRING), 1, 10) < '1996-01-01'")
both("rel_join2", "SELECT c_mktsegment, COUNT(*) AS n, ROUND(AVG(o_totalprice), 4) AS mean_price FROM {customer} JOIN {orders} ON c_custkey = o_custkey GROUP BY c_mktsegment")
both("rel_join3", "SELECT n_name, COUNT(*) AS n, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {nation} JOIN {customer} ON n_nationkey = c_nationkey JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY n_name")
both("rel_left_join", "SELECT c_custkey, COUNT(o_orderkey) AS n FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey GROUP BY c_custkey")
both("rel_agg_global", "SELECT COUNT(*) AS n, ROUND(AVG(l_quantity), 6) AS mean_quantity, MIN(l_extendedprice) AS least, MAX(l_extendedprice) AS most FROM {lineitem}")
both("rel_group_count", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(AVG(l_discount), 6) AS mean_discount FROM {lineitem} GROUP BY l_returnflag, l_linestatus")
both("rel_count_distinct", "SELECT COUNT(DISTINCT l_partkey) AS parts, COUNT(DISTINCT l_suppkey) AS suppliers FROM {lineitem}")
both("rel_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM {orders}")
both("rel_order_by_alias", "SELECT o_orderpriority, COUNT(*) AS n FROM {orders} GROUP BY o_orderpriority ORDER BY n DESC, o_orderpriority")
both("rel_topk", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
both("rel_having", "SELECT o_custkey, COUNT(*) AS n FROM {orders} GROUP BY o_custkey HAVING COUNT(*) > 15")
both("rel_scalar_subquery", "SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT AVG(o_totalprice) * 1.8 FROM {orders})")
both("rel_scalar_subquery_substr", "SELECT c_custkey, c_mktsegment FROM {customer} WHERE SUBSTR(c_mktsegment, 1, 1) = (SELECT MIN(SUBSTR(c_mktsegment, 1, 1)) FROM {customer})")
both("rel_component_recovery", "SELECT c_custkey, SUBSTR(v, 1, INSTR(v, ' - ') - 1) AS first_part FROM (SELECT c_custkey, c_name || ' - ' || c_mktsegment AS v FROM {customer}) x")
both("rel_cast_coalesce", "SELECT l_returnflag, SUM(CAST(COALESCE(l_linenumber, 0) AS BIGINT)) AS lines FROM {lineitem} GROUP BY l_returnflag", None)
ORACLE["rel_cast_coalesce"] = "SELECT l_returnflag, SUM(COALESCE(l_linenumber, 0))::BIGINT AS lines FROM lineitem GROUP BY l_returnflag"


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def rel_not_in(spark: SparkSession, t: Tables) -> DataFrame:
    return joins.not_in(t["orders"].select("o_orderkey"), "o_orderkey", t["lineitem"], "l_orderkey")


# Evolution of data.
STALE = "SELECT c_mktsegment, ROUND(AVG(c_acctbal), 6) AS mean_balance, COUNT(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY c_mktsegment"


def _evolved(spark: SparkSession, t: Tables, specs: list[dict], names: tuple[str, ...], sql: str) -> DataFrame:
    """Evolves tables, classifies what changed from their catalogs, rewrites a stale query and runs it on the new tables."""
    before = {n: t[n] for n in names}
    after, _ = evolve.apply(before, specs)
    events = schema.difference(catalog.describe(spark, before), catalog.describe(spark, after))
    rewritten = relink.relink(spark, sql, events)["sql"]
    for name in after:
        rewritten = rewritten.replace(f" {name} ", " {" + name + "} ")
    return spark.sql(rewritten + " ", **after) if rewritten.count("{") else spark.sql(rewritten)


@query(STALE)
def evolve_table_rename(spark: SparkSession, t: Tables) -> DataFrame:
    return _evolved(spark, t, [{"op": "TABLE_RENAME", "from": "customer", "to": "client"}], ("customer",), STALE)


@query(STALE)
def evolve_column_rename(spark: SparkSession, t: Tables) -> DataFrame:
    return _evolved(spark, t, [{"op": "COLUMN_RENAME", "table": "customer", "from": "c_acctbal", "to": "balance"}], ("customer",), STALE)


@query(STALE)
def evolve_rename_both(spark: SparkSession, t: Tables) -> DataFrame:
    specs = [{"op": "TABLE_RENAME", "from": "customer", "to": "client"}, {"op": "COLUMN_RENAME", "table": "client", "from": "c_acctbal", "to": "balance"}]
    return _evolved(spark, t, specs, ("customer",), STALE)


@query("SELECT o_orderstatus, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus")
def evolve_split_rejoin(spark: SparkSession, t: Tables) -> DataFrame:
    """A split table under its old name, by a view that joins only what the query uses."""
    before = {"orders": t["orders"]}
    parts = {"order_head": ["o_custkey", "o_orderstatus", "o_orderdate"], "order_money": ["o_totalprice", "o_orderpriority"]}
    after = evolve.split_table(before, "orders", "o_orderkey", parts)
    columns = lambda frames: {n: f.columns for n, f in frames.items()}
    events = schema.difference(catalog.describe(spark, before), catalog.describe(spark, after))
    view = relink.compatible_views(events, columns(before), columns(after), {"o_orderstatus", "o_totalprice"})["orders"]
    for name in after:
        view = view.replace(f"FROM {name} ", "FROM {" + name + "} AS " + name + " ").replace(f"JOIN {name} ", "JOIN {" + name + "} AS " + name + " ")
    return t.sql("SELECT o_orderstatus, ROUND(SUM(o_totalprice), 2) AS total FROM {view} GROUP BY o_orderstatus", view=spark.sql(view, **after))


#: Stale queries in which a name's meaning depends on where it stands; each shows k and v.
NESTED = {
    "a definition hides the table": "WITH orders AS (SELECT c_custkey AS o_custkey, c_mktsegment AS o_orderstatus FROM customer) SELECT o_orderstatus AS k, COUNT(*) AS v FROM orders GROUP BY o_orderstatus",
    "a definition reads the table it hides": "WITH orders AS (SELECT * FROM orders WHERE o_totalprice > 100000) SELECT o_orderstatus AS k, COUNT(*) AS v FROM orders GROUP BY o_orderstatus",
    "a derived table's column": "SELECT x.o_orderstatus AS k, COUNT(*) AS v FROM (SELECT o_orderstatus FROM orders) x GROUP BY x.o_orderstatus",
    "a derived table's star": "SELECT t.o_orderstatus AS k, SUM(o_custkey) AS v FROM (SELECT * FROM orders) t GROUP BY t.o_orderstatus",
    "a chain of definitions": "WITH a AS (SELECT o_custkey, o_orderstatus FROM orders), b(s) AS (SELECT o_orderstatus FROM a WHERE o_custkey > 10) SELECT s AS k, COUNT(*) AS v FROM b GROUP BY s",
    "a join by a shared name": "SELECT c_mktsegment AS k, COUNT(*) AS v FROM orders JOIN (SELECT c_custkey AS o_custkey, c_mktsegment FROM customer) c USING (o_custkey) GROUP BY c_mktsegment",
    "a join by all shared names": "SELECT c_mktsegment AS k, COUNT(*) AS v FROM orders NATURAL JOIN (SELECT c_custkey AS o_custkey, c_mktsegment FROM customer) c GROUP BY c_mktsegment",
    "an inner column of the same name": "SELECT o_orderpriority AS k, (SELECT COUNT(DISTINCT o_orderstatus) FROM (SELECT c_mktsegment AS o_orderstatus FROM customer) y) AS v FROM orders GROUP BY o_orderpriority",
    "an outer column from within": "SELECT c_mktsegment AS k, COUNT(*) AS v FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') GROUP BY c_mktsegment",
    "an alias of the column's name": "SELECT o_orderpriority AS k, MAX(o_orderstatus) AS v FROM (SELECT o_orderpriority, COUNT(*) AS o_orderstatus FROM orders GROUP BY o_orderpriority, o_orderstatus) n GROUP BY o_orderpriority",
    "both sides of a union": "SELECT k, COUNT(*) AS v FROM (SELECT o_orderstatus AS k FROM orders UNION ALL SELECT c_mktsegment FROM customer) u GROUP BY k",
}


@query(" UNION ALL ".join(f"SELECT '{case.replace(chr(39), chr(39) * 2)}' AS reading, CAST(k AS VARCHAR) AS k, CAST(v AS BIGINT) AS v FROM ({sql})" for case, sql in NESTED.items()))
def relink_nested(spark: SparkSession, t: Tables) -> DataFrame:
    """Stale queries over a renamed table with renamed columns give what they gave, in whatever scope names stand."""
    before = {n: t[n] for n in ("orders", "customer")}
    specs = [{"op": "TABLE_RENAME", "from": "orders", "to": "purchases"}, {"op": "COLUMN_RENAME", "table": "purchases", "from": "o_orderstatus", "to": "order status"}, {"op": "COLUMN_RENAME", "table": "purchases", "from": "o_custkey", "to": "buyer"}]
    after, made = evolve.apply(before, specs)
    columns = [{n: f.dtypes for n, f in tables.items()} for tables in (before, after)]
    with workload.views(spark, after):
        frames = [spark.sql(relink.relink(spark, sql, made.events, pre=columns[0], post=columns[1])["sql"]).select(F.lit(case).alias("reading"), F.col("k").cast("string"), F.col("v").cast("long")) for case, sql in NESTED.items()]
    return reduce(DataFrame.unionByName, frames)


def _over_split(spark: SparkSession, t: Tables, table: str, key: str, parts: dict[str, list[str]], sql: str) -> DataFrame:
    """A stale query over a table that was split, by definitions that leave out only parts which the tables' keys allow."""
    before = {table: t[table]}
    after = evolve.split_table(before, table, key, parts)
    events = [{"op": "TABLE_SPLIT", "source": table, "targets": list(parts), "key": key}]
    columns = [{n: f.dtypes for n, f in tables.items()} for tables in (before, after)]
    with workload.views(spark, after):
        return spark.sql(relink.relink(spark, sql, events, pre=columns[0], post=columns[1], facts=keys.facts(after, events))["sql"])


@query("SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus")
def relink_split_unique(spark: SparkSession, t: Tables) -> DataFrame:
    """Orders have one row a key in each part, so only the part in use is read."""
    return _over_split(spark, t, "orders", "o_orderkey", {"order_head": ["o_orderstatus", "o_custkey"], "order_money": ["o_totalprice"]}, "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus")


@query("SELECT l_returnflag, COUNT(*) AS n FROM lineitem a JOIN (SELECT l_orderkey FROM lineitem) b USING (l_orderkey) GROUP BY l_returnflag")
def relink_split_repeated(spark: SparkSession, t: Tables) -> DataFrame:
    """Parts of lineitem repeat their key, so the other part counts though no column of it is used, and the join stays."""
    return _over_split(spark, t, "lineitem", "l_orderkey", {"line_state": ["l_returnflag"], "line_goods": ["l_partkey", "l_quantity"]}, "SELECT l_returnflag, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag")


@query("SELECT a.table_name, a.is_unique, b.included FROM (SELECT 'customer' AS table_name, COUNT(*) = COUNT(DISTINCT c_custkey) AS is_unique FROM customer UNION ALL SELECT 'orders', COUNT(*) = COUNT(DISTINCT o_custkey) FROM orders) a JOIN (SELECT 'customer' AS table_name, NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS included UNION ALL SELECT 'orders', NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))) b USING (table_name)")
def key_facts(spark: SparkSession, t: Tables) -> DataFrame:
    """Whether a key is unique in each of two tables, and whether the other has all of its keys."""
    tables = {"customer": t["customer"].select(F.col("c_custkey").alias("k")), "orders": t["orders"].select(F.col("o_custkey").alias("k"))}
    counts = keys.key_counts(tables, "k")
    told = counts.agg(*[F.struct(F.lit(n).alias("table_name"), F.bool_and(F.col(n) <= 1).alias("is_unique"), F.bool_and((F.col(n) == 0) | (F.col(o) > 0)).alias("included")).alias(n) for n, o in (("customer", "orders"), ("orders", "customer"))])
    return told.select(F.explode(F.array("customer", "orders")).alias("x")).select("x.table_name", "x.is_unique", "x.included")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def evolve_split_one_side(spark: SparkSession, t: Tables) -> DataFrame:
    """A query that uses one side of a split reads that side alone."""
    after = evolve.split_table({"orders": t["orders"]}, "orders", "o_orderkey", {"head": ["o_orderstatus"], "rest": ["o_totalprice"]})
    return after["head"].where("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus")


@query("SELECT (SELECT COUNT(DISTINCT o_orderkey) FROM orders JOIN lineitem ON o_orderkey = l_orderkey) AS kept, (SELECT COUNT(*) FROM orders) AS total")
def evolve_merge_loss(spark: SparkSession, t: Tables) -> DataFrame:
    merged = evolve.merge_tables({"orders": t["orders"], "lineitem": t["lineitem"]}, "orders", "lineitem", ("o_orderkey", "l_orderkey"), "order_line")
    kept = merged["order_line"].agg(F.count_distinct("o_orderkey").alias("kept"))
    return kept.join(t["orders"].agg(F.count("*").alias("total")))


@query("SELECT o_orderstatus, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderstatus")
def evolve_merge(spark: SparkSession, t: Tables) -> DataFrame:
    merged = evolve.merge_tables({"orders": t["orders"], "lineitem": t["lineitem"]}, "orders", "lineitem", ("o_orderkey", "l_orderkey"), "order_line")
    return merged["order_line"].groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


MERGED = "c_name || ' - ' || c_mktsegment"


@query(f"SELECT c_custkey, {MERGED} AS name_segment FROM customer")
def evolve_column_merge(spark: SparkSession, t: Tables) -> DataFrame:
    return evolve.merge_columns({"customer": t["customer"]}, "customer", ["c_name", "c_mktsegment"], "name_segment", MERGED)["customer"].select("c_custkey", "name_segment")


@query("SELECT c_custkey, c_mktsegment FROM customer")
def evolve_column_merge_inverse(spark: SparkSession, t: Tables) -> DataFrame:
    """The old column by a view over the merged one."""
    before = {"customer": t["customer"]}
    after = evolve.merge_columns(before, "customer", ["c_name", "c_mktsegment"], "name_segment", MERGED)
    events = schema.difference(catalog.describe(spark, before), catalog.describe(spark, after), strict_merge=True)
    events = [e | ({"sources": ["c_name", "c_mktsegment"], "expression": MERGED} if e["op"] == "COLUMN_MERGE" else {}) for e in events]
    columns = lambda frames: {n: f.columns for n, f in frames.items()}
    view = relink.compatible_views(events, columns(before), columns(after))["customer"]
    return spark.sql(view.replace("FROM customer", "FROM {customer}"), **after).select("c_custkey", "c_mktsegment")


@query("SELECT o_orderkey, coalesce(CAST(o_orderstatus AS VARCHAR), '') || ' ' || coalesce(CAST(nullif(o_orderpriority, '5-LOW') AS VARCHAR), '') AS merged FROM orders")
def evolve_column_merge_coalesce(spark: SparkSession, t: Tables) -> DataFrame:
    own = t["orders"].withColumn("p", F.nullif("o_orderpriority", F.lit("5-LOW")))
    return evolve.merge_columns({"orders": own}, "orders", ["o_orderstatus", "p"], "merged")["orders"].select("o_orderkey", "merged")


@query("SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM nation")
def evolve_rename_by_position(spark: SparkSession, t: Tables) -> DataFrame:
    return evolve.rename_by_position({"nation": t["nation"]}, "nation", ["k", "name", "r"])["nation"]


@query("SELECT event_id, event_type, user_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS place FROM events) WHERE place <= 2")
def stratified_first_k(spark: SparkSession, t: Tables) -> DataFrame:
    return evolve.first_per_group(t["events"].select("event_id", "event_type", "user_id"), ["event_type", "user_id"], ["event_id"], 2)


# Schemas. Catalogs are given as rows, so that both engines see the same names and types.
OLD = {"vessel": [("Vessel_ID", "INTEGER"), ("Label", "TEXT"), ("Built", "INTEGER")], "dock": [("Dock_ID", "INTEGER"), ("Year", "INTEGER")]}


VENUE = [("Venue_ID", "INTEGER"), ("City", "TEXT")]


def _values(tables: dict[str, list[tuple[str, str]]]) -> str:
    rows = [f"('{t}', '{c}', '{k}', {i})" for t, cs in tables.items() for i, (c, k) in enumerate(cs)]
    return f"(VALUES {', '.join(rows)}) AS c(table_name, column_name, data_type, ordinal)"


_CANON = "SELECT string_agg(lower(table_name) || ':' || columns, '$$' ORDER BY lower(table_name)) AS canonical FROM (SELECT table_name, string_agg(lower(column_name) || '|' || lower(data_type), '||' ORDER BY lower(column_name)) AS columns FROM {0} GROUP BY table_name)"


@query(f"SELECT canonical, sha256(canonical) AS fingerprint FROM ({_CANON.format(_values(OLD))})")
def schema_fingerprint(spark: SparkSession, t: Tables) -> DataFrame:
    return schema.fingerprint(catalog.from_columns(spark, OLD))


_TYPES = "CASE data_type WHEN 'INTEGER' THEN 'int' WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' ELSE lower(data_type) END"
_INFO = f"(SELECT table_name, column_name, {_TYPES} AS data_type, CAST(ordinal_position - 1 AS INTEGER) AS ordinal FROM information_schema.columns WHERE table_name IN ({', '.join(repr(n) for n in catalog.TABLES)}))"


@query(f"SELECT * FROM {_INFO}")
def schema_introspect(spark: SparkSession, t: Tables) -> DataFrame:
    return catalog.describe(spark, {n: t[n] for n in catalog.TABLES})


@query(f"SELECT sha256(canonical) AS fingerprint FROM ({_CANON.format(_INFO)})")
def schema_fingerprint_tables(spark: SparkSession, t: Tables) -> DataFrame:
    return schema.fingerprint(catalog.describe(spark, {n: t[n] for n in catalog.TABLES})).select("fingerprint")


@query(f"SELECT table_name, 'TABLE ' || table_name || ' ( ' || string_agg(column_name || ' ' || data_type, ', ' ORDER BY ordinal) || ' )' AS line FROM {_values(OLD)} GROUP BY table_name")
def schema_prompt_block(spark: SparkSession, t: Tables) -> DataFrame:
    return schema.prompt_block(catalog.from_columns(spark, OLD))


@query("SELECT 'table_' || i AS table_name, c AS column_name, k AS data_type, o::INTEGER AS ordinal FROM generate_series(0, 99) AS g(i), (VALUES ('id', 'INTEGER', 0), ('c1', 'TEXT', 1), ('c2', 'INTEGER', 2), ('c3', 'REAL', 3)) AS v(c, k, o)")
def schema_synthetic(spark: SparkSession, t: Tables) -> DataFrame:
    return catalog.synthetic(spark, 100)


def _change(name: str, new: dict[str, list[tuple[str, str]]], sql: str, strict_merge: bool = False, old: dict[str, list[tuple[str, str]]] = OLD) -> None:
    """A classified difference between two catalogs, with SQL that finds it from them."""

    def run(spark: SparkSession, root: str) -> DataFrame:
        events = schema.difference(catalog.from_columns(spark, old), catalog.from_columns(spark, new), strict_merge)
        return schema.events_frame(spark, events).select("op", F.coalesce("from", "source", F.array_join("sources", ","), "column", "table").alias("before"), F.coalesce("to", "target", F.array_join("targets", ","), "column", "table").alias("after"))

    QUERIES[name] = run
    ORACLE[name] = f"WITH pre AS (SELECT * FROM {_values(old)}), post AS (SELECT * FROM {_values(new)}), gone AS (SELECT * FROM pre WHERE table_name NOT IN (SELECT table_name FROM post)), fresh AS (SELECT * FROM post WHERE table_name NOT IN (SELECT table_name FROM pre)), lost AS (SELECT * FROM pre WHERE table_name IN (SELECT table_name FROM post) AND (table_name, lower(column_name)) NOT IN (SELECT table_name, lower(column_name) FROM post)), got AS (SELECT * FROM post WHERE table_name IN (SELECT table_name FROM pre) AND (table_name, lower(column_name)) NOT IN (SELECT table_name, lower(column_name) FROM pre)) " + sql


_SHAPE = "(SELECT table_name, list_sort(list(lower(column_name) || ' ' || lower(data_type))) AS shape, list_sort(list(lower(data_type))) AS types, list(lower(column_name)) AS names FROM {0} GROUP BY table_name)"
_change(
    "schema_classify_table_rename",
    {"boat": OLD["vessel"], "dock": OLD["dock"]},
    f"SELECT 'TABLE_RENAME' AS op, a.table_name AS before, b.table_name AS after FROM {_SHAPE.format('gone')} a JOIN {_SHAPE.format('fresh')} b USING (shape)",
)
_change(
    "schema_classify_combined",
    {"boat": [("Vessel_ID", "INTEGER"), ("Long_Label", "TEXT"), ("Built", "INTEGER")], "dock": OLD["dock"]},
    f"SELECT 'TABLE_RENAME' AS op, a.table_name AS before, b.table_name AS after FROM {_SHAPE.format('gone')} a JOIN {_SHAPE.format('fresh')} b USING (types) UNION ALL SELECT 'COLUMN_RENAME', g.column_name, f.column_name FROM gone g JOIN fresh f ON g.data_type = f.data_type WHERE lower(g.column_name) NOT IN (SELECT lower(column_name) FROM fresh) AND lower(f.column_name) NOT IN (SELECT lower(column_name) FROM gone)",
)
_change(
    "schema_classify_split",
    {"vessel_built": [("Vessel_ID", "INTEGER"), ("Built", "INTEGER")], "vessel_label": [("Vessel_ID", "INTEGER"), ("Label", "TEXT")], "dock": OLD["dock"]},
    f"SELECT 'TABLE_SPLIT' AS op, a.table_name AS before, string_agg(b.table_name, ',' ORDER BY b.table_name) AS after FROM {_SHAPE.format('gone')} a JOIN {_SHAPE.format('fresh')} b ON list_has_all(a.names, b.names) GROUP BY a.table_name HAVING count(*) >= 2",
)
_change(
    "schema_classify_merge",
    {"venue": VENUE, "billing": [("Vessel_ID", "INTEGER"), ("Label", "TEXT"), ("Built", "INTEGER"), ("Fee", "REAL")]},
    f"SELECT 'TABLE_MERGE' AS op, string_agg(a.table_name, ',' ORDER BY a.table_name) AS before, b.table_name AS after FROM {_SHAPE.format('gone')} a JOIN {_SHAPE.format('fresh')} b ON list_has_all(b.names, a.names) GROUP BY b.table_name HAVING count(*) >= 2",
    old={"vessel": OLD["vessel"], "fees": [("Vessel_ID", "INTEGER"), ("Fee", "REAL")], "venue": VENUE},
)
_change(
    "schema_classify_column_rename",
    {"vessel": [("Vessel_ID", "INTEGER"), ("call_label", "TEXT"), ("Built", "INTEGER")], "dock": OLD["dock"]},
    "SELECT 'COLUMN_RENAME' AS op, l.column_name AS before, g.column_name AS after FROM lost l JOIN got g ON l.table_name = g.table_name AND l.data_type = g.data_type",
)
_change(
    "schema_classify_column_merge",
    {"vessel": [("Vessel_ID", "INTEGER"), ("label_built", "TEXT")], "dock": OLD["dock"]},
    "SELECT 'COLUMN_MERGE' AS op, (SELECT string_agg(column_name, ',' ORDER BY column_name) FROM lost) AS before, (SELECT column_name FROM got) AS after",
    strict_merge=True,
)
_change(
    "schema_classify_add_remove",
    {"vessel": [("Vessel_ID", "INTEGER"), ("Label", "TEXT"), ("Fee", "REAL")], "venue": [("Venue_ID", "INTEGER")]},
    "SELECT 'TABLE_REMOVE' AS op, table_name AS before, table_name AS after FROM gone GROUP BY table_name UNION ALL SELECT 'TABLE_ADD', table_name, table_name FROM fresh GROUP BY table_name UNION ALL SELECT 'COLUMN_REMOVE', column_name, column_name FROM lost UNION ALL SELECT 'COLUMN_ADD', column_name, column_name FROM got",
)


# The same over the catalog of the given tables: what a change makes of all of them.
_ALL = f"SELECT table_name, lower(column_name) AS c, data_type AS k, ordinal FROM {_INFO}"


def _held(spark: SparkSession, t: Tables) -> DataFrame:
    return catalog.describe(spark, {n: t[n] for n in catalog.TABLES})


def _parts(whole: DataFrame) -> DataFrame:
    """Each table of a catalog as two: its first column stands in both, the others in turns. Tables of three columns or more."""
    wide = whole.groupBy("table_name").agg(F.max("ordinal").alias("last")).where("last >= 2")
    half = F.when(F.col("ordinal") == 0, F.array(F.lit("odd"), F.lit("even"))).otherwise(F.array(F.when(F.col("ordinal") % 2 == 1, "odd").otherwise("even")))
    own = whole.join(wide, "table_name").select("table_name", F.explode(half).alias("half"), "column_name", "data_type", "ordinal")
    return own.withColumn("table_name", F.concat_ws("_", "table_name", "half")).drop("half")


_WIDE = f"(SELECT table_name, first(c ORDER BY ordinal) AS key FROM ({_ALL}) GROUP BY table_name HAVING count(*) >= 3)"


@query(f"SELECT table_name, 'TABLE ' || table_name || ' ( ' || string_agg(column_name || ' ' || data_type, ', ' ORDER BY ordinal) || ' )' AS line FROM {_INFO} GROUP BY table_name")
def schema_prompt_tables(spark: SparkSession, t: Tables) -> DataFrame:
    return schema.prompt_block(_held(spark, t))


def _by_table(whole: DataFrame, parts: DataFrame, merged: bool) -> DataFrame:
    """Events of each wide table and its parts, pairs side by side; merged if the parts come first."""
    name = F.regexp_replace("table_name", "_(odd|even)$", "")
    sides = [df.select("*", name.alias("pair"), F.lit(side).alias("side")) for df, side in ((whole, "post" if merged else "pre"), (parts, "pre" if merged else "post"))]
    events = schema.difference_of_pairs(sides[0].join(parts.select(name.alias("pair")).distinct(), "pair").unionByName(sides[1]))
    return events.select(F.from_json("event", schema.EVENTS).alias("e")).select("e.*")


@query(f"SELECT 'TABLE_SPLIT' AS op, table_name AS source, table_name || '_even,' || table_name || '_odd' AS targets, key FROM {_WIDE}")
def schema_split_tables(spark: SparkSession, t: Tables) -> DataFrame:
    whole = _held(spark, t)
    return _by_table(whole, _parts(whole), False).select("op", "source", F.array_join("targets", ",").alias("targets"), "key")


@query(f"SELECT 'TABLE_MERGE' AS op, table_name || '_even,' || table_name || '_odd' AS sources, table_name AS target, key FROM {_WIDE}")
def schema_merge_tables(spark: SparkSession, t: Tables) -> DataFrame:
    whole = _held(spark, t)
    return _by_table(whole, _parts(whole), True).select("op", F.array_join("sources", ",").alias("sources"), "target", "key")


_AFTER = f"SELECT table_name, c, k, ordinal FROM ({_ALL}) WHERE table_name NOT LIKE 'p%' AND ordinal <> 2 UNION ALL SELECT table_name, 'added', 'date', 99 FROM ({_ALL}) WHERE table_name NOT LIKE 'p%' AND ordinal = 0 UNION ALL SELECT 'new_' || table_name, c, k, ordinal FROM ({_ALL}) WHERE table_name LIKE 'e%' AND ordinal = 0"


@query(f"WITH pre AS ({_ALL}), post AS ({_AFTER}) SELECT 'TABLE_REMOVE' AS op, table_name AS \"table\", NULL::VARCHAR AS \"column\" FROM pre WHERE table_name NOT IN (SELECT table_name FROM post) GROUP BY table_name UNION ALL SELECT 'TABLE_ADD', table_name, NULL FROM post WHERE table_name NOT IN (SELECT table_name FROM pre) GROUP BY table_name UNION ALL SELECT 'COLUMN_REMOVE', table_name, c FROM pre WHERE table_name IN (SELECT table_name FROM post) AND (table_name, c) NOT IN (SELECT table_name, c FROM post) UNION ALL SELECT 'COLUMN_ADD', table_name, c FROM post WHERE table_name IN (SELECT table_name FROM pre) AND (table_name, c) NOT IN (SELECT table_name, c FROM pre)")
def schema_add_remove_tables(spark: SparkSession, t: Tables) -> DataFrame:
    """Tables whose names begin with p go, their like with e get another beside them, and the others lose their third column and get one."""
    pre = _held(spark, t)
    kept = pre.where("table_name NOT LIKE 'p%'")
    added = kept.where("ordinal = 0").select("table_name", F.lit("added").alias("column_name"), F.lit("date").alias("data_type"), F.lit(99).alias("ordinal"))
    beside = pre.where("table_name LIKE 'e%' AND ordinal = 0").withColumn("table_name", F.concat(F.lit("new_"), "table_name"))
    post = kept.where("ordinal <> 2").unionByName(added).unionByName(beside)
    return schema.events_frame(spark, schema.difference(pre, post)).select("op", "table", F.col("column"))


@query(f"WITH x AS ({_ALL}), parts AS (SELECT table_name || '_' || unnest(CASE WHEN ordinal = 0 THEN ['odd', 'even'] WHEN ordinal % 2 = 1 THEN ['odd'] ELSE ['even'] END) AS table_name, c FROM x WHERE table_name IN (SELECT table_name FROM {_WIDE})) SELECT a.table_name AS outer_table, b.table_name AS inner_table FROM (SELECT table_name, list(c) AS has FROM x GROUP BY table_name) a JOIN (SELECT table_name, list(c) AS needs FROM parts GROUP BY table_name) b ON list_has_all(a.has, b.needs)")
def schema_containment(spark: SparkSession, t: Tables) -> DataFrame:
    whole = _held(spark, t)
    return schema.containment(whole, _parts(whole))


@query(f"SELECT table_name AS source, 'TABLE_SPLIT: the columns of ' || table_name || ' are in [' || table_name || '_even, ' || table_name || '_odd], which share ' || key || '.' || chr(10) || '- Read from those of them that hold a column in use, joined on ' || key || '.' AS rules FROM {_WIDE}")
def relink_guidance_tables(spark: SparkSession, t: Tables) -> DataFrame:
    """What a generator is told of each given table's split."""
    whole = _held(spark, t)
    events = [{k: v for k, v in r.asDict().items() if v is not None} for r in _by_table(whole, _parts(whole), False).collect()]  # an event a table
    return spark.createDataFrame([(e["source"], relink.guidance([e])) for e in events], "source string, rules string")


@query(f"SELECT table_name, string_agg(column_name, ', ' ORDER BY ordinal) AS columns FROM {_INFO} GROUP BY table_name")
def benchmark_columns_tables(spark: SparkSession, t: Tables) -> DataFrame:
    """Columns as they are read back from definitions of the given tables."""
    kind = F.when(F.col("data_type").isin("bigint", "int"), "integer").when(F.col("data_type") == "double", "real").otherwise("text")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.concat_ws(" ", "column_name", kind).alias("c")))), lambda x: x["c"]), ", ")
    made = _held(spark, t).groupBy("table_name").agg(body.alias("body")).select("table_name", F.format_string("CREATE TABLE %s (%s)", "table_name", "body").alias("ddl"))
    return spark.createDataFrame([(r.table_name, ", ".join(benchmark.ddl_columns(r.ddl))) for r in made.collect()], "table_name string, columns string")  # a definition a table


@query(f"SELECT a.table_name, 'show count ' || lower(replace(a.column_name, '_', ' ')) || ' n where ' || lower(replace(b.column_name, '_', ' ')) || ' grouped ' || a.table_name AS paraphrase, 'medium' AS complexity FROM {_INFO} a JOIN {_INFO} b ON a.table_name = b.table_name AND a.ordinal = 0 AND b.ordinal = 1")
def query_descriptions_tables(spark: SparkSession, t: Tables) -> DataFrame:
    """A query over each given table in key words, and how hard it is."""
    first = _held(spark, t).where("ordinal < 2").groupBy("table_name").agg(F.max_by("column_name", -F.col("ordinal")).alias("a"), F.max_by("column_name", "ordinal").alias("b")).collect()
    texts = {r.table_name: f"SELECT {r.a}, COUNT(*) AS n FROM {r.table_name} WHERE {r.b} IS NOT NULL GROUP BY {r.a}" for r in first}
    return spark.createDataFrame([(name, validate.paraphrase(sql), validate.complexity(spark, sql)) for name, sql in texts.items()], "table_name string, paraphrase string, complexity string")


# Results and their scores. Three arms are derived from rows of lineitem.
_ARMS = "SELECT l_returnflag AS perturbation, CAST(l_linenumber = 7 AS {0}) AS expected_failure, CAST(l_quantity > 30 AS {0}) AS baseline_ok, CAST(l_quantity > 10 AS {0}) AS refreshed_schema_ok, CAST(l_quantity > 28 AS {0}) AS error_feedback_ok, CAST(l_quantity > 15 OR l_discount > 0.05 AS {0}) AS mcp_ok, CASE WHEN l_tax > 0.04 THEN 'valid' ELSE 'silent_failure' END AS mcp_verdict FROM {1}"


def _arms(t: Tables) -> DataFrame:
    return t.sql(_ARMS.format("INT", "{lineitem}"))


_RUNS = f"(SELECT * FROM ({_ARMS.format('INTEGER', 'lineitem')}) WHERE expected_failure = 0)"
_SUMS = ", ".join(f"SUM({c})::BIGINT AS {a}_k" for a, c in evaluate.ARMS.items())


@query(f"SELECT perturbation, COUNT(*) AS n, {', '.join(f'SUM({c})::BIGINT AS {a}_correct' for a, c in evaluate.ARMS.items())}, COUNT(*) FILTER (baseline_ok = 0 AND mcp_ok = 1) AS recovered, COUNT(*) FILTER (baseline_ok = 1 AND mcp_ok = 0) AS degraded, {', '.join(f'ROUND(SUM({c}) / COUNT(*)::DOUBLE, 4) AS {a}_rate' for a, c in evaluate.ARMS.items())} FROM {_RUNS} GROUP BY perturbation")
def stat_per_operator(spark: SparkSession, t: Tables) -> DataFrame:
    return evaluate.per_operator(_arms(t))


_WILSON = "(({0} / {1}::DOUBLE + 1.9208 / {1}) {2} 1.96 * sqrt(({0} / {1}::DOUBLE * (1 - {0} / {1}::DOUBLE) + 3.8416 / (4 * {1})) / {1})) / (1 + 3.8416 / {1}::DOUBLE)"
_POOLED = f"SELECT {{0}} n, {', '.join(f'ROUND({a}_k / n::DOUBLE, 6) AS {a}_ex' for a in evaluate.ARMS)}, ROUND(greatest(0.0, {_WILSON.format('mediated_k', 'n', '-')}), 6) AS lower, ROUND(least(1.0, {_WILSON.format('mediated_k', 'n', '+')}), 6) AS upper, ROUND((mediated_k - stale_k)::DOUBLE / nullif(refreshed_k - stale_k, 0), 6) AS recovery FROM (SELECT {{0}} COUNT(*) AS n, {_SUMS} FROM {_RUNS} {{1}})"


@query(_POOLED.format("perturbation,", "GROUP BY perturbation"))
def stat_group_ex(spark: SparkSession, t: Tables) -> DataFrame:
    return evaluate.pooled(_arms(t), "perturbation")


@query(_POOLED.format("", ""))
def stat_recovery_rate(spark: SparkSession, t: Tables) -> DataFrame:
    return evaluate.pooled(_arms(t))


@query(f"SELECT perturbation, COUNT(*) AS n, COUNT(*) FILTER (mcp_verdict <> 'valid') AS flagged FROM ({_ARMS.format('INTEGER', 'lineitem')}) WHERE expected_failure = 1 GROUP BY perturbation")
def stat_expected_failures(spark: SparkSession, t: Tables) -> DataFrame:
    return evaluate.expected_failures(_arms(t))


@query("SELECT category, COALESCE(n, 0) AS n FROM (VALUES ('correct'), ('execution_error'), ('silent_failure'), ('wrong_result'), ('unknown')) c(category) LEFT JOIN (SELECT CASE WHEN l_quantity > 25 THEN 'correct' WHEN l_discount > 0.08 THEN 'execution_error' WHEN l_tax < 0.02 THEN 'silent_failure' ELSE 'wrong_result' END AS category, COUNT(*) AS n FROM lineitem GROUP BY 1) USING (category)")
def stat_error_categories(spark: SparkSession, t: Tables) -> DataFrame:
    verdict = F.when(F.col("l_tax") < 0.02, "silent_failure").otherwise("valid")
    own = t["lineitem"].select(evaluate.category((F.col("l_quantity") > 25).cast("int"), F.col("l_discount") > 0.08, verdict, F.lit(True)).alias("category"))
    return evaluate.category_counts(own)


_TAIL = "SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) FROM generate_series(0, least(b, c)) AS g(i)"


@query(f"SELECT b, c, CASE WHEN n > 0 THEN ROUND((abs(b - c) - 1) ** 2 / n::DOUBLE, 6) END AS statistic, CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE ROUND(least(1.0, 2 * ({_TAIL})), 6) END AS p_value FROM (SELECT *, b + c AS n FROM (SELECT COUNT(*) FILTER (quality = 0 AND toxic = 1) AS b, COUNT(*) FILTER (quality = 1 AND toxic = 0) AS c FROM labels))")
def stat_mcnemar(spark: SparkSession, t: Tables) -> DataFrame:
    return stats.mcnemar(t["labels"], F.col("quality"), F.col("toxic"))


@query("WITH p AS (SELECT n_name AS name, (n_nationkey + 1) / 500.0::DOUBLE AS p_value FROM nation), o AS (SELECT *, row_number() OVER (ORDER BY p_value, name) AS i, count(*) OVER () AS m FROM p) SELECT name, p_value, ROUND(least(1.0, max((m - i + 1) * p_value) OVER (ORDER BY p_value, name ROWS UNBOUNDED PRECEDING)), 6) AS adjusted FROM o")
def stat_holm(spark: SparkSession, t: Tables) -> DataFrame:
    return stats.holm(t["nation"].select(F.col("n_name").alias("name"), ((F.col("n_nationkey") + 1) / 500.0).alias("p_value")))


@query("WITH p AS (SELECT c_name AS name, ((c_custkey * 7919) % 100003 + 1) / 5000200.0::DOUBLE AS p_value FROM customer), o AS (SELECT *, row_number() OVER (ORDER BY p_value, name) AS i, count(*) OVER () AS m FROM p) SELECT name, p_value, ROUND(least(1.0, max((m - i + 1) * p_value) OVER (ORDER BY p_value, name ROWS UNBOUNDED PRECEDING)), 6) AS adjusted FROM o")
def stat_holm_customers(spark: SparkSession, t: Tables) -> DataFrame:
    """A family with a test for each customer."""
    return stats.holm(t["customer"].select(F.col("c_name").alias("name"), ((F.col("c_custkey") * 7919 % 100003 + 1) / F.lit(5000200.0)).alias("p_value")))


@query(f"SELECT l_returnflag, k, n, ROUND(greatest(0.0, {_WILSON.format('k', 'n', '-')}), 6) AS lower, ROUND(least(1.0, {_WILSON.format('k', 'n', '+')}), 6) AS upper FROM (SELECT l_returnflag, COUNT(*) FILTER (l_linestatus = 'F') AS k, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag)")
def stat_wilson(spark: SparkSession, t: Tables) -> DataFrame:
    got = t["lineitem"].groupBy("l_returnflag").agg(F.count_if(F.col("l_linestatus") == "F").alias("k"), F.count("*").alias("n"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return got.select("*", F.round(low, 6).alias("lower"), F.round(high, 6).alias("upper"))


@query("WITH v AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, count(*) AS n, ROUND(avg(v), 6) AS mean, ROUND(median(v), 6) AS median, ROUND(coalesce(median(v) FILTER (i <= n // 2), min(v)), 6) AS q1, ROUND(coalesce(median(v) FILTER (i > n - n // 2), max(v)), 6) AS q3, ROUND(coalesce(median(v) FILTER (i > n - n // 2), max(v)) - coalesce(median(v) FILTER (i <= n // 2), min(v)), 6) AS iqr, ROUND(max(v) FILTER (i = (95 * n + 99) // 100), 6) AS p95, ROUND(min(v), 6) AS min, ROUND(max(v), 6) AS max FROM v GROUP BY event_type")
def stat_latency_summary(spark: SparkSession, t: Tables) -> DataFrame:
    return stats.latency(t["events"], "event_type", "value")


@query("SELECT COUNT(*) AS items, COUNT(*) FILTER (same) AS stable, ROUND(COUNT(*) FILTER (same) / COUNT(*)::DOUBLE, 6) AS share FROM (SELECT user_id, min(event_type) = max(event_type) AS same FROM events GROUP BY user_id)")
def stat_seed_stability(spark: SparkSession, t: Tables) -> DataFrame:
    return evaluate.stability(t["events"], "user_id", F.col("event_type"))


@query("SELECT ROUND(avg(ex), 6) AS mean, ROUND(min(ex), 6) AS min, ROUND(max(ex), 6) AS max, ROUND(max(ex) - min(ex), 6) AS range FROM (SELECT l_linenumber, avg((l_quantity > 25)::INTEGER) AS ex FROM lineitem GROUP BY l_linenumber)")
def stat_by_seed(spark: SparkSession, t: Tables) -> DataFrame:
    return evaluate.by_seed(t["lineitem"], "l_linenumber", (F.col("l_quantity") > 25).cast("int"))


@query("SELECT tp, fp, fn, tn, ROUND(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, ROUND(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, ROUND(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1 FROM (SELECT COUNT(*) FILTER (quality = 0 AND toxic = 1) AS tp, COUNT(*) FILTER (quality = 0 AND toxic = 0) AS fp, COUNT(*) FILTER (quality = 1 AND toxic = 1) AS fn, COUNT(*) FILTER (quality = 1 AND toxic = 0) AS tn FROM labels)")
def stat_confusion(spark: SparkSession, t: Tables) -> DataFrame:
    return evaluate.confusion(t["labels"], F.col("quality") == 0, F.col("toxic") == 1)


@query("SELECT source, COUNT(*) AS n, COUNT(*) FILTER (quality = 0) AS flagged, ROUND(COUNT(*) FILTER (quality = 0) / COUNT(*)::DOUBLE, 6) AS recall FROM labels JOIN documents USING (doc_id) GROUP BY source")
def stat_recall_by_group(spark: SparkSession, t: Tables) -> DataFrame:
    return evaluate.recall_by(t["labels"].join(t["documents"].select("doc_id", "source"), "doc_id"), "source", F.col("quality") == 0)


@query("SELECT threshold, tp, fp, fn, tn, ROUND(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, ROUND(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall FROM (SELECT threshold, COUNT(*) FILTER (f AND a) AS tp, COUNT(*) FILTER (f AND NOT a) AS fp, COUNT(*) FILTER (NOT f AND a) AS fn, COUNT(*) FILTER (NOT f AND NOT a) AS tn FROM (SELECT threshold, l_discount * 10 < threshold OR l_tax > 0.07 AS f, l_returnflag = 'R' AS a FROM lineitem, (VALUES (0.35::DOUBLE), (0.45::DOUBLE), (0.6::DOUBLE)) v(threshold)) GROUP BY threshold)")
def stat_threshold_sweep(spark: SparkSession, t: Tables) -> DataFrame:
    return evaluate.sweep(t["lineitem"], F.col("l_discount") * 10, F.col("l_tax") > 0.07, F.col("l_returnflag") == "R", [0.35, 0.45, 0.6])


@query("SELECT COUNT(*) FILTER (contains(c_name, '7') ) AS contaminated, COUNT(*) AS n, COUNT(*) FILTER (contains(c_name, '7')) / COUNT(*)::DOUBLE AS fraction FROM customer")
def stat_contamination(spark: SparkSession, t: Tables) -> DataFrame:
    own = t["customer"].select(F.when(F.col("c_name").contains("7"), results.MARK + "error").otherwise("hosted").alias("backend"))
    return results.contaminated(own)


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def resume_anti_join(spark: SparkSession, t: Tables) -> DataFrame:
    return results.pending(t["orders"].select("o_orderkey"), t["lineitem"].select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("SELECT COUNT(*) AS n, ROUND(AVG((l = r)::INTEGER), 6) AS agreement FROM (SELECT o_orderkey, (o_totalprice > 100000)::INTEGER AS l FROM orders) JOIN (SELECT o_orderkey, (o_orderstatus = 'F')::INTEGER AS r FROM orders WHERE o_orderstatus <> 'P') USING (o_orderkey)")
def stat_paired_agreement(spark: SparkSession, t: Tables) -> DataFrame:
    a = t["orders"].select("o_orderkey", (F.col("o_totalprice") > 100000).cast("int").alias("ok"))
    b = t["orders"].select("o_orderkey", F.when(F.col("o_orderstatus") != "P", (F.col("o_orderstatus") == "F").cast("int")).alias("ok"))
    return evaluate.agreement(evaluate.paired(a, b, ["o_orderkey"], "ok"))


@query(f"SELECT config, COUNT(*) AS n, ROUND(AVG(ok), 6) AS ex FROM (SELECT unnest(['baseline_ok', 'mcp_ok', 'refreshed_schema_ok']) AS config, unnest([baseline_ok, mcp_ok, refreshed_schema_ok]) AS ok FROM {_RUNS}) GROUP BY config")
def stat_ablation(spark: SparkSession, t: Tables) -> DataFrame:
    own = evaluate.long_form(evaluate.scored(_arms(t)), ["perturbation"], ["baseline_ok", "mcp_ok", "refreshed_schema_ok"])
    return own.groupBy("config").agg(F.count("*").alias("n"), F.round(F.avg("ok"), 6).alias("ex"))


@query("SELECT event_type AS model, COUNT(*) AS n, ROUND(SUM(i * usd_in + o * usd_out) / 1e6, 4) AS usd, ROUND(AVG(i), 6) AS mean_in, ROUND(AVG(o), 6) AS mean_out FROM (SELECT event_type, event_id % 1000 AS i, event_id % 77 AS o FROM events) JOIN (VALUES ('click', 1.0::DOUBLE, 5.0::DOUBLE), ('view', 0.15::DOUBLE, 0.6::DOUBLE), ('purchase', 2.5::DOUBLE, 10.0::DOUBLE)) p(event_type, usd_in, usd_out) USING (event_type) GROUP BY event_type")
def stat_cost(spark: SparkSession, t: Tables) -> DataFrame:
    own = t["events"].select(F.col("event_type").alias("model"), (F.col("event_id") % 1000).alias("tokens_in"), (F.col("event_id") % 77).alias("tokens_out"))
    prices = spark.createDataFrame([("click", 1.0, 5.0), ("view", 0.15, 0.6), ("purchase", 2.5, 10.0)], "model string, usd_in double, usd_out double")
    return evaluate.cost(own, prices)


@query("SELECT tool, COUNT(*) AS rows FROM (SELECT unnest(CASE WHEN event_id % 5 = 0 THEN ['none'] WHEN event_id % 3 = 0 THEN ['relink', 'validate'] ELSE ['validate'] END) AS tool FROM events) GROUP BY tool")
def stat_tool_usage(spark: SparkSession, t: Tables) -> DataFrame:
    call = lambda *names: F.lit("[" + ", ".join(f'{{"tool": "{n}", "args": {{}}}}' for n in names) + "]")
    made = F.when(F.col("event_id") % 5 == 0, call()).when(F.col("event_id") % 3 == 0, call("relink", "validate", "relink")).otherwise(call("validate"))
    return evaluate.tool_usage(t["events"].select(made.alias("tool_calls_json")))


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, COUNT(*) AS n FROM events GROUP BY 1")
def json_props(spark: SparkSession, t: Tables) -> DataFrame:
    return t["events"].groupBy(F.from_json("props", "k bigint")["k"].alias("k")).agg(F.count("*").alias("n"))


_CDF = [sum(0.36787944117144233 / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880, 3628800, 39916800)[: k + 1]) for k in range(12)]
_UNIT = "('0x' || substr(md5('0:' || d // 4 || ':' || {0}), 8 * (d % 4) + 1, 8))::BIGINT / 4294967296.0::DOUBLE"
_WEIGHT = " + ".join(f"(u >= {c!r})::INTEGER" for c in _CDF)


@query(f"WITH w AS (SELECT d, v, {_WEIGHT} AS w FROM (SELECT d, o_totalprice AS v, {_UNIT.format('o_orderkey')} AS u FROM orders, generate_series(0, 999) AS g(d))), m AS (SELECT list_sort(list(m)) AS m FROM (SELECT sum(v * w) / sum(w) AS m FROM w GROUP BY d)) SELECT (SELECT COUNT(*) FROM orders) AS n, (SELECT ROUND(AVG(o_totalprice), 4) FROM orders) AS estimate, ROUND(m[26], 4) AS lower, ROUND(m[975], 4) AS upper FROM m")
def stat_bootstrap_hash(spark: SparkSession, t: Tables) -> DataFrame:
    got = stats.bootstrap(t["orders"], "o_orderkey", "o_totalprice", 1000)
    return got.select("n", *[F.round(c, 4).alias(c) for c in ("estimate", "lower", "upper")])


@query(f"WITH q AS (SELECT doc_id, quality AS s, 1 AS f, greatest(quality, toxic) AS a FROM labels), w AS (SELECT d, s, f, a, {_WEIGHT} AS w FROM (SELECT d, s, f, a, {_UNIT.format('doc_id')} AS u FROM q, generate_series(0, 9999) AS g(d))), m AS (SELECT (sum(a * w) - sum(s * w)) / nullif(sum(f * w) - sum(s * w), 0)::DOUBLE AS m FROM w GROUP BY d), l AS (SELECT list_sort(list(m) FILTER (m IS NOT NULL)) AS m, COUNT(*) FILTER (m IS NULL) AS degenerate FROM m) SELECT (SELECT ROUND((sum(a) - sum(s)) / nullif(sum(f) - sum(s), 0)::DOUBLE, 4) FROM q) AS point, degenerate, ROUND(m[1 + floor(len(m) * 0.025)::INTEGER], 4) AS lower, ROUND(m[least(len(m), 1 + floor(len(m) * 0.975)::INTEGER)], 4) AS upper FROM l")
def stat_bootstrap_recovery(spark: SparkSession, t: Tables) -> DataFrame:
    return stats.bootstrap_recovery(t["labels"], "doc_id", F.col("quality"), F.lit(1), F.greatest("quality", "toxic"))


@query(f"SELECT tp, fn, ROUND(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS rate FROM (SELECT COUNT(*) FILTER (baseline_ok = 0 AND mcp_verdict = 'silent_failure') AS tp, COUNT(*) FILTER (baseline_ok = 0 AND mcp_verdict = 'valid' AND mcp_ok = 0) AS fn FROM {_RUNS})")
def stat_silent_detection(spark: SparkSession, t: Tables) -> DataFrame:
    return evaluate.silent_detection(_arms(t))


_EX = ", ".join(f"ROUND({a}_k / n::DOUBLE, 4) AS ex_{a}, ROUND(greatest(0.0, {_WILSON.format(f'{a}_k', 'n', '-')}), 6) AS {a}_lower, ROUND(least(1.0, {_WILSON.format(f'{a}_k', 'n', '+')}), 6) AS {a}_upper" for a in evaluate.ARMS)


@query(f"SELECT *, ROUND((ex_mediated - ex_stale) / nullif(ex_refreshed - ex_stale, 0), 4) AS rr_mediated, ROUND((ex_error_feedback - ex_stale) / nullif(ex_refreshed - ex_stale, 0), 4) AS rr_error_feedback FROM (SELECT bucket, n, {_EX} FROM (SELECT CASE perturbation WHEN 'A' THEN 'easy' WHEN 'N' THEN 'medium' ELSE 'hard' END AS bucket, COUNT(*) AS n, {_SUMS} FROM {_RUNS} GROUP BY 1))")
def stat_complexity_buckets(spark: SparkSession, t: Tables) -> DataFrame:
    bucket = F.when(F.col("perturbation") == "A", "easy").when(F.col("perturbation") == "N", "medium").otherwise("hard")
    return evaluate.by_bucket(evaluate.scored(_arms(t)).withColumn("bucket", bucket))


@query()
def stat_bootstrap_exact(spark: SparkSession, t: Tables) -> DataFrame:
    return stats.bootstrap_exact(t["events"].select("event_type", "value"), "event_type", "value")


_BAG = "SELECT COUNT(*) AS differing FROM ((SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT ALL SELECT * FROM a))"


@query(f"WITH a AS (SELECT l_returnflag, l_linenumber FROM lineitem WHERE l_quantity > 20), b AS (SELECT l_returnflag, l_linenumber FROM lineitem WHERE l_quantity >= 20) {_BAG}")
def result_bag_equal(spark: SparkSession, t: Tables) -> DataFrame:
    own = t["lineitem"].select("l_returnflag", "l_linenumber", "l_quantity")
    a, b = (own.where(f"l_quantity {op} 20").drop("l_quantity") for op in (">", ">="))
    return evaluate.row_difference(a, b).agg(F.coalesce(F.sum(F.abs("surplus")), F.lit(0)).alias("differing"))


_GATES = [
    ("same", "SELECT o_orderkey, o_orderstatus FROM {orders}", "SELECT o_orderkey, o_orderstatus FROM {orders} ORDER BY o_orderkey", "TABLE_RENAME"),
    ("other rows", "SELECT o_orderkey FROM {orders} WHERE o_orderkey > 7", "SELECT o_orderkey FROM {orders} WHERE o_orderkey >= 7", "TABLE_RENAME"),
    ("repeats", "SELECT o_orderstatus FROM {orders}", "SELECT DISTINCT o_orderstatus FROM {orders}", "TABLE_SPLIT"),
    ("none before", "SELECT o_orderkey FROM {orders} WHERE o_orderkey < 0", "SELECT o_orderkey FROM {orders}", "TABLE_RENAME"),
    ("none after", "SELECT o_orderkey FROM {orders}", "SELECT o_orderkey FROM {orders} WHERE o_orderkey < 0", "COLUMN_MERGE"),
    ("merged", "SELECT c_name FROM {customer}", "SELECT c_name || ' ' || c_mktsegment AS c FROM {customer}", "COLUMN_MERGE"),
    ("fails before", "SELECT nope FROM {orders}", "SELECT o_orderkey FROM {orders}", "TABLE_RENAME"),
    ("fails after", "SELECT o_orderkey FROM {orders}", "SELECT 1 / (o_orderkey - o_orderkey) AS x FROM {orders}", "TABLE_RENAME"),
    ("merged and fewer", "SELECT c_name FROM {customer}", "SELECT c_name || ' ' || c_mktsegment AS c FROM {customer} WHERE c_custkey > 9", "COLUMN_MERGE"),
]


def _gate_sql(name: str, pre: str, post: str, op: str) -> str:
    if name.startswith("fails"):
        return f"SELECT '{name}' AS item, 'execution_error_{'pre' if name == 'fails before' else 'post'}' AS gate"
    a, b = (f"({x.replace('{', '').replace('}', '')})" for x in (pre, post))
    differ = f"(SELECT COUNT(*) FROM {a}) <> (SELECT COUNT(*) FROM {b})"
    last = f"WHEN {differ} THEN 'row_count_mismatch'" if op == "COLUMN_MERGE" else f"WHEN EXISTS ({a} EXCEPT ALL {b}) OR EXISTS ({b} EXCEPT ALL {a}) THEN 'result_mismatch'"
    return f"SELECT '{name}' AS item, CASE WHEN NOT EXISTS {a} THEN 'empty_pre' WHEN NOT EXISTS {b} THEN 'empty_post' {last} ELSE 'ok' END AS gate"


@query(" UNION ALL ".join(_gate_sql(*g) for g in _GATES))
def gold_gate(spark: SparkSession, t: Tables) -> DataFrame:
    plain = lambda sql: sql.replace("{", "").replace("}", "")
    tables = {"orders": t["orders"], "customer": t["customer"]}
    items = [(name, {"gold_pre": plain(pre), "gold_post": plain(post), "perturbation": op}) for name, pre, post, op in _GATES]
    return spark.createDataFrame([(name, workload.gate(spark, item, tables, tables) or "ok") for name, item in items], "item string, gate string")


# Queries made wrong, judged and described. Golds run on the test tables.
_GOLD = {
    "filtered": "SELECT o_orderstatus, MIN(o_totalprice) AS v FROM orders WHERE o_orderkey > 100 GROUP BY o_orderstatus",
    "listed": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5",
    "joined": "SELECT orders.o_orderkey, customer.c_name FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey WHERE orders.o_orderkey <= 50",
    "merged": "SELECT name_segment FROM client WHERE c_custkey = 3",
}
_MERGE = [{"op": "COLUMN_MERGE", "table": "client", "target": "name_segment", "sources": ["c_mktsegment", "c_name"]}]
#: Each mutant by hand, for the other engine.
_MUTANTS = [
    ("filtered", "drop_where", "SELECT o_orderstatus, MIN(o_totalprice) AS v FROM orders GROUP BY o_orderstatus"),
    ("filtered", "swap_agg_min", "SELECT o_orderstatus, MAX(o_totalprice) AS v FROM orders WHERE o_orderkey > 100 GROUP BY o_orderstatus"),
    ("filtered", "wrong_column", "SELECT o_orderkey, MIN(o_totalprice) AS v FROM orders WHERE o_orderkey > 100 GROUP BY o_orderstatus"),
    ("filtered", "spurious_limit_one", None),
    ("listed", "wrong_column", "SELECT o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5"),
    ("listed", "limit_minus_one", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 4"),
    ("listed", "limit_plus_one", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 6"),
    ("joined", "drop_where", "SELECT orders.o_orderkey, customer.c_name FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey"),
    ("joined", "wrong_column", "SELECT orders.o_custkey, customer.c_name FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey WHERE orders.o_orderkey <= 50"),
    ("joined", "spurious_limit_one", None),
    ("joined", "wrong_join_key", "SELECT orders.o_orderkey, customer.c_name FROM orders JOIN customer ON orders.o_custkey = customer.c_nationkey WHERE orders.o_orderkey <= 50"),
    ("merged", "drop_where", "SELECT name_segment FROM client"),
    ("merged", "wrong_column", "SELECT c_custkey FROM client WHERE c_custkey = 3"),
    ("merged", "stale_merge_eq", "SELECT name_segment FROM client WHERE name_segment = (SELECT min(substr(name_segment, 1, 1)) FROM client)"),
    ("merged", "spurious_limit_one", None),
]
_CLIENT = "(SELECT c_custkey, c_name || ' - ' || c_mktsegment AS name_segment FROM customer)"


def _columns(t: Tables) -> dict[str, list[str]]:
    return {"orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"], "customer": ["c_custkey", "c_nationkey", "c_name"], "client": ["name_segment", "c_custkey"]}


def _own_tables(t: Tables) -> dict[str, DataFrame]:
    client = t.sql("SELECT c_custkey, c_name || ' - ' || c_mktsegment AS name_segment FROM {customer}")
    return {"orders": t["orders"], "customer": t["customer"], "client": client}


def _shown(name: str, mutation: str, sql: str | None) -> str:
    """How many rows a mutant gives, and whether it is one of those that can't run."""
    if mutation in ("spurious_limit_one",):
        return f"SELECT '{name}' AS gold, '{mutation}' AS mutation, 1::BIGINT AS n"
    if (name, mutation) == ("filtered", "wrong_column"):
        return f"SELECT '{name}' AS gold, '{mutation}' AS mutation, -1::BIGINT AS n"
    return f"SELECT '{name}' AS gold, '{mutation}' AS mutation, (SELECT COUNT(*) FROM ({sql.replace('FROM client', 'FROM ' + _CLIENT + ' client')})) AS n"


@query(" UNION ALL ".join(_shown(*m) for m in _MUTANTS))
def mutate_families(spark: SparkSession, t: Tables) -> DataFrame:
    """All mutants of the golds, and how many rows each gives; -1 for one that doesn't run."""
    held = answers.Answers(spark, _own_tables(t))
    made = [(name, *m) for name, sql in _GOLD.items() for m in mutate.mutants(sql, _columns(t), _MERGE if name == "merged" else None, expanded=True)]
    answers.ahead(spark, [(held, sql) for _, _, sql in made])
    counts = [(name, mutation, -1 if (got := held.answer(sql)).error is not None else got.n) for name, mutation, sql in made]
    return spark.createDataFrame(counts, "gold string, mutation string, n bigint")


def _differs(gold: str, sql: str) -> str:
    a, b = (f"({x.replace('FROM client', 'FROM ' + _CLIENT + ' client')})" for x in (gold, sql))
    return f"EXISTS ({a} EXCEPT ALL {b}) OR EXISTS ({b} EXCEPT ALL {a})"


@query(
    " UNION ALL ".join(
        [f"SELECT '{n}__gold' AS id, 'valid' AS label, 'none' AS mutation" for n in ("filtered", "joined")]
        + [f"SELECT '{g}__{m}' AS id, 'silent_failure' AS label, '{m}' AS mutation WHERE {_differs(_GOLD[g], sql)}" for g, m, sql in _MUTANTS if g in ("filtered", "joined") and m in ("drop_where", "swap_agg_min") or (g, m) == ("joined", "wrong_column")]
    )
)
def mutate_label(spark: SparkSession, t: Tables) -> DataFrame:
    """Cases that run and answer otherwise than their gold."""
    items = [{"id": n, "question": f"list {n}", "gold_post": _GOLD[n]} for n in ("filtered", "joined")]
    with workload.views(spark, _own_tables(t)):
        cases = mutate.label(spark, items, _columns(t))
    return mutate.label_frame(spark, cases).select("id", "label", "mutation")


_JUDGED = [
    ("fails", "SELECT nope FROM orders", "list the orders"),
    ("overflows", "SELECT 1 / (o_orderkey - o_orderkey) AS x FROM orders", "list the orders"),
    ("other", "SELECT o_totalprice FROM orders", "zebra quux"),
    ("nothing", "SELECT o_orderkey FROM orders WHERE o_orderkey < 0", "show the key of all orders"),
    ("zero", "SELECT COUNT(*) FROM orders WHERE o_orderkey < 0", "how many orders are there"),
    ("good", "SELECT COUNT(*) FROM orders", "how many orders are there"),
    ("many", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000", "show the key of orders"),
]


@query("SELECT 'fails' AS item, 'execution_error' AS verdict, NULL AS reason, -1::BIGINT AS row_count UNION ALL SELECT 'overflows', 'execution_error', NULL, -1 UNION ALL SELECT 'other', 'silent_failure', 'low_token_overlap', (SELECT COUNT(*) FROM orders) UNION ALL SELECT 'nothing', 'silent_failure', 'empty_result_on_affirmative_question', (SELECT COUNT(*) FROM orders WHERE o_orderkey < 0) UNION ALL SELECT 'zero', 'silent_failure', 'empty_result_on_affirmative_question', 1 UNION ALL SELECT 'good', 'valid', NULL, 1 UNION ALL SELECT 'many', 'valid', NULL, (SELECT COUNT(*) FROM orders WHERE o_totalprice > 100000)")
def validate_verdicts(spark: SparkSession, t: Tables) -> DataFrame:
    with workload.views(spark, {"orders": t["orders"]}):
        got = [(name, validate.validate(spark, sql, question)) for name, sql, question in _JUDGED]
    return spark.createDataFrame([(n, v.verdict, v.reason, -1 if v.row_count is None else v.row_count) for n, v in got], "item string, verdict string, reason string, row_count bigint")


@query("SELECT * FROM (VALUES ('counted', 'show count n song name where is male ordered grouped vessel', 'medium'), ('joined', 'show label hall yard dock', 'medium'), ('nested', 'show max built where built built vessel vessel', 'hard'), ('having', 'show count city grouped venue', 'hard'), ('plain', 'show first name city', 'easy')) v(item, paraphrase, complexity)")
def query_descriptions(spark: SparkSession, t: Tables) -> DataFrame:
    """Queries in key words, and how hard they are."""
    texts = {
        "counted": "SELECT count(*) AS n, T1.Song_Name FROM vessel AS T1 WHERE T1.Is_male = 'T' GROUP BY T1.Song_Name ORDER BY n",
        "joined": "SELECT Label, T2.Hall FROM yard JOIN dock AS T2 ON yard.id = T2.id",
        "nested": "SELECT Built FROM vessel WHERE Built = (SELECT max(Built) FROM vessel)",
        "having": "SELECT City, count(*) FROM venue GROUP BY City HAVING count(*) > 1",
        "plain": "SELECT first_name FROM city",
    }
    return spark.createDataFrame([(k, validate.paraphrase(q), validate.complexity(spark, q)) for k, q in texts.items()], "item string, paraphrase string, complexity string")


@query("SELECT * FROM (VALUES ('rename', 0, false), ('split', 2, false), ('merge', 2, false), ('columns', 4, true), ('columns unknown', 2, false)) v(item, lines, names_separator)")
def relink_guidance(spark: SparkSession, t: Tables) -> DataFrame:
    """Rules for a generator: how many, and whether they name what stands between merged values."""
    events = {
        "rename": {"op": "TABLE_RENAME", "from": "a", "to": "b"},
        "split": {"op": "TABLE_SPLIT", "source": "t", "targets": ["a", "b"], "key": "id"},
        "merge": {"op": "TABLE_MERGE", "sources": ["a", "b"], "target": "t", "key": "id"},
        "columns": {"op": "COLUMN_MERGE", "table": "t", "sources": ["a", "b"], "target": "ab", "expression": "a || ' ~ ' || b"},
        "columns unknown": {"op": "COLUMN_MERGE", "table": "t", "sources": ["a", "b"], "target": "ab"},
    }
    said = {k: relink.guidance([e]) for k, e in events.items()}
    return spark.createDataFrame([(k, len(x.splitlines()), "~" in x) for k, x in said.items()], "item string, lines int, names_separator boolean")


_ASKED = [
    ("q1", "count the purchase with orderpriority urgent", "SELECT COUNT(*) FROM orders WHERE o_orderpriority = '1-URGENT'", "SELECT COUNT(*) FROM purchase WHERE o_orderpriority = '1-URGENT'"),
    ("q2", "show the price of purchase with orderstatus finished", "SELECT o_totalprice FROM orders WHERE o_orderstatus = 'F'", "SELECT price FROM purchase WHERE o_orderstatus = 'F'"),
    ("q3", "show the name of nations", "SELECT n_name FROM nation", "SELECT n_name FROM nation"),
    ("q4", "which order has no key", "SELECT o_orderkey FROM orders WHERE o_orderkey IS NULL", None),
]


@query("SELECT * FROM (VALUES ('q1', 1, 0, 0, 0, 1, 1), ('q2', 1, 0, 0, 0, 1, 1), ('q3', 1, 1, 1, 1, 1, 0), ('q4', -1, -1, -1, -1, -1, 0)) v(id, pre_ok, baseline_ok, refreshed_schema_ok, error_feedback_ok, mcp_ok, recovered)")
def run_arms(spark: SparkSession, t: Tables) -> DataFrame:
    """An evaluation run whose generator only knows the old names: only the mediated arm gets over the change."""
    before = {"orders": t["orders"], "nation": t["nation"]}
    after, _ = evolve.apply(before, [{"op": "TABLE_RENAME", "from": "orders", "to": "purchase"}, {"op": "COLUMN_RENAME", "table": "purchase", "from": "o_totalprice", "to": "price"}])
    known = {question: pre for _, question, pre, _ in _ASKED}
    items = [{"id": i, "question": q, "gold_pre": pre, "gold_post": post, "perturbation": "TABLE_RENAME", "expected_failure": post is None} for i, q, pre, post in _ASKED]
    rows = workload.evaluate_items(spark, items, before, after, lambda text_: next(sql for q, sql in known.items() if f"Question: {q}" in text_))
    return rows.select("id", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("pre_ok", "baseline_ok", "refreshed_schema_ok", "error_feedback_ok", "mcp_ok")], "recovered")


# Text rules.
_STOPS = "[" + ", ".join(f"'{w}'" for w in text.STOP) + "]"
_PLAIN = "list_filter(list_distinct(regexp_extract_all(lower({0}), '[a-z]+')), lambda x: NOT list_contains(" + _STOPS + ", x))"
_MEANS = "MAP {" + ", ".join(f"'{k}': [{', '.join(repr(x) for x in v)}]" for k, v in text.SYNONYMS.items()) + "}"


def _tokens(c: str) -> str:
    plain = _PLAIN.format(c)
    return f"list_distinct(list_concat({plain}, flatten(list_transform({plain}, lambda x: coalesce({_MEANS}[x], [])))))"


@query(f"SELECT conv_id, turn, len({_tokens('text')})::INTEGER AS n_tokens, array_to_string(list_sort({_tokens('text')}), ' ') AS tokens FROM conversations")
def text_tokens(spark: SparkSession, t: Tables) -> DataFrame:
    held = text.tokens(F.col("text"))
    return t["conversations"].select("conv_id", "turn", F.size(held).alias("n_tokens"), F.array_join(F.array_sort(held), " ").alias("tokens"))


@query(f"SELECT a.conv_id, a.turn, ROUND(CASE WHEN len(list_distinct(list_concat(x, y))) = 0 THEN 1.0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE END, 9) AS overlap FROM (SELECT conv_id, turn, {_tokens('text')} AS x FROM conversations) a JOIN (SELECT conv_id, turn, {_tokens('text')} AS y FROM conversations) b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def text_jaccard(spark: SparkSession, t: Tables) -> DataFrame:
    own = t["conversations"].select("conv_id", "turn", text.tokens(F.col("text")).alias("x"))
    after = own.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("x").alias("y"))
    return own.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(text.jaccard(F.col("x"), F.col("y")), 9).alias("overlap"))


_CUES = {"affirmative": text.AFFIRMATIVE, "scalar": text.SCALAR, "grouped": text.GROUPED, "several": text.SEVERAL, "listed": text.LISTED}


@query("SELECT conv_id, turn, " + ", ".join(f"regexp_matches(text, '(?i){p}') AS {n}" for n, p in _CUES.items()) + " FROM conversations")
def text_affirmative(spark: SparkSession, t: Tables) -> DataFrame:
    return t["conversations"].select("conv_id", "turn", *[text.cue(F.col("text"), p).alias(n) for n, p in _CUES.items()])


_CUE = lambda p: f"regexp_matches(text, '(?i){p}')"


@query(
    f"SELECT role, COUNT(*) AS n, COUNT(*) FILTER ({_CUE(text.SEVERAL)} AND turn = 1) AS arity_low, COUNT(*) FILTER ({_CUE(text.AFFIRMATIVE)} AND (length(text) % 7 = 0 OR turn = 2)) AS affirmative_empty, "
    f"COUNT(*) FILTER ({_CUE(text.SCALAR)} AND NOT {_CUE(text.GROUPED)} AND length(text) % 7 > 1) AS scalar_multi_rows, COUNT(*) FILTER ({_CUE(text.LISTED)} AND length(text) % 7 = 1) AS list_single_row FROM (SELECT role, turn, 'list the ' || text AS text FROM conversations UNION ALL SELECT role, turn, 'how many ' || text FROM conversations) GROUP BY role"
)
def sfd_rules(spark: SparkSession, t: Tables) -> DataFrame:
    asked = t.sql("SELECT role, turn, 'list the ' || text AS text FROM {conversations} UNION ALL SELECT role, turn, 'how many ' || text FROM {conversations}")
    rules = evaluate.suspicions(F.col("text"), F.length("text") % 7, F.col("turn"), F.col("turn") == 2)
    return asked.groupBy("role").agg(F.count("*").alias("n"), *[F.count_if(c).alias(n) for n, c in rules.items()])


@query("SELECT vec_id, other, ROUND(list_sum(list_transform(list_zip(x, y), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / nullif(sqrt(list_sum(list_transform(x, lambda p: p::DOUBLE * p::DOUBLE))) * sqrt(list_sum(list_transform(y, lambda p: p::DOUBLE * p::DOUBLE))), 0), 6) AS cosine FROM (SELECT a.vec_id, b.vec_id AS other, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)")
def vec_cosine(spark: SparkSession, t: Tables) -> DataFrame:
    a = t["embeddings"].select("vec_id", F.col("embedding").alias("x"))
    b = t["embeddings"].select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other"), F.col("embedding").alias("y"))
    return a.join(b, "vec_id").select("vec_id", "other", F.round(text.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


_WRAPPED = "replace(replace(trim(regexp_replace(text, '[^A-Za-z ]', ' ', 'g')), '  ', ' '), '  ', ' ')"


@query(f"SELECT conv_id, turn, 'SELECT ' || chr(39) || trim({_WRAPPED}) || chr(39) AS sql FROM conversations")
def strip_fences(spark: SparkSession, t: Tables) -> DataFrame:
    """Answers of every form: bare, fenced with and without a language, after thinking, with semicolons and blanks."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace("text", "[^A-Za-z ]", " ")), "  ", " "), "  ", " ")
    sql = F.concat(F.lit("SELECT '"), F.trim(plain), F.lit("'"))
    forms = [("", ""), ("```sql\n", "\n```"), ("```\n", ";\n```  "), ("<think>maybe\n```</think>\n ```SQL ", "```"), (" \n", " ;; "), ("<think></think>", ";")]
    kind = (F.col("conv_id") + F.col("turn")) % len(forms)
    wrapped = F.coalesce(*[F.when(kind == k, F.concat(F.lit(a), sql, F.lit(b))) for k, (a, b) in enumerate(forms)])
    return t["conversations"].select("conv_id", "turn", text.strip_fences(wrapped).alias("sql"))


# Catalog and benchmark pieces over the test tables.
@query("SELECT * FROM (VALUES ('as it is', false, 0), ('other order', false, 0), ('renamed', true, 1), ('retyped', true, 0), ('first look', true, 0)) v(look, changed, events)")
def schema_changes(spark: SparkSession, t: Tables) -> DataFrame:
    """What a cache of schemas says of looks at a schema: the first one, the same, and changed ones against the one before."""
    looks = {
        "first look": {"nation": t["nation"]},
        "as it is": {"nation": t["nation"]},
        "other order": {"nation": t["nation"].select(*reversed(t["nation"].columns))},
        "renamed": {"state": t["nation"]},
        "retyped": {"state": t["nation"].withColumn("n_nationkey", F.col("n_nationkey").cast("string"))},
    }
    cache, out = schema.SchemaCache(), []
    for name, frames in looks.items():
        got = cache.look("db", catalog.describe(spark, frames))
        out.append((name, got["changed"], len(schema.events_text(got["events"]).splitlines())))
    return spark.createDataFrame(out, "look string, changed boolean, events int")


@query("SELECT * FROM (VALUES ('again', true), ('other order', true), ('repartitioned', true), ('a row less', false), ('other specification', false)) v(tables, same)")
def evolve_content_hash(spark: SparkSession, t: Tables) -> DataFrame:
    """Whether tables have the hash of the customers: rows and specifications count, order and partitions don't."""
    specs = [{"op": "TABLE_RENAME", "from": "a", "to": "b"}]
    own = evolve.content_hash({"customer": t["customer"]}, specs)
    others = {
        "again": (t["customer"], specs),
        "other order": (t["customer"].orderBy(F.desc("c_custkey")), specs),
        "repartitioned": (t["customer"].repartition(7), specs),
        "a row less": (t["customer"].where("c_custkey > 1"), specs),
        "other specification": (t["customer"], []),
    }
    return spark.createDataFrame([(k, evolve.content_hash({"customer": f}, s) == own) for k, (f, s) in others.items()], "tables string, same boolean")


@query("SELECT * FROM (VALUES ('plain', 'id, name'), ('blanks and brackets', 'id, Percent (%) Free (K-12), full name'), ('foreign keys', 'id, town_id'), ('list', 'a, b')) v(definition, columns)")
def benchmark_columns(spark: SparkSession, t: Tables) -> DataFrame:
    entries = {
        "plain": "CREATE TABLE t (id integer primary key, name text)",
        "blanks and brackets": {"ddl": "t (id int, Percent (%) Free (K-12) real, full name text, primary key(id))"},
        "foreign keys": "t (id int, foreign key(town_id) references town(id) integer, foreign key(id) references u(id))",
        "list": {"ddl": "broken", "columns": ["a", "foreign key(b) references u(b)", "A"]},
    }
    return spark.createDataFrame([(k, ", ".join(benchmark.entry_columns(e))) for k, e in entries.items()], "definition string, columns string")


_SPEC = {
    "old_new_table_mapping": {"orders": "sale", "lineitem": "sale"},
    "query": "SELECT COUNT(*) FROM lineitem AS T1 INNER JOIN orders AS T2 ON T1.l_orderkey = T2.o_orderkey",
    "new_relevant_table": {"sale": "sale (o_orderkey int, o_orderstatus text, l_quantity real, price_orders real)"},
    "deduplicate_new_column_to_old_table_old_table_mapping": {"price_orders": {"old_table": "orders", "old_column": "o_totalprice"}},
}


@query("SELECT o_orderstatus, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS quantity, ROUND(MAX(o_totalprice), 2) AS price FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderstatus")
def benchmark_merge(spark: SparkSession, t: Tables) -> DataFrame:
    """A merge as a benchmark's item describes it: joined as its query joins, with the columns that its definition lists."""
    made = benchmark.materialize({"orders": t["orders"], "lineitem": t["lineitem"]}, {"op": "TABLE_MERGE", "spec": _SPEC})["sale"]
    return made.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.max("price_orders"), 2).alias("price"))


#: Golds whose join of orders with customer stands deep, beside other joins, without qualifiers, or in a USING.
_JOINS = {
    "nested": "SELECT n FROM (SELECT COUNT(*) AS n FROM orders AS T1 JOIN customer AS T2 ON T1.o_custkey = T2.c_custkey WHERE T1.o_orderkey IN (SELECT T1.l_orderkey FROM lineitem AS T1)) x",
    "several": "SELECT T3.n_name FROM lineitem AS T4 JOIN orders AS T1 ON T4.l_orderkey = T1.o_orderkey JOIN customer AS T2 ON T2.c_custkey = T1.o_custkey JOIN nation AS T3 ON T3.n_nationkey = T2.c_nationkey",
    "plain": "SELECT o_orderkey FROM orders, customer WHERE o_orderkey > 5 AND c_custkey = o_custkey",
    "using": "SELECT o_orderkey FROM lineitem JOIN orders USING (l_orderkey) JOIN customer USING (c_custkey)",
}


@query(" UNION ALL ".join(f"SELECT '{case}' AS gold, COUNT(*) AS n, ROUND(SUM(c_acctbal), 2) AS balance FROM orders JOIN customer ON o_custkey = c_custkey" for case in _JOINS))
def benchmark_joins(spark: SparkSession, t: Tables) -> DataFrame:
    """Merges of two tables on what each gold joins them on."""
    made = []
    for case, sql in _JOINS.items():
        tables = {"orders": t["orders"].select("o_orderkey", "o_custkey"), "customer": t["customer"].select("c_custkey", "c_acctbal")}
        if case == "using":
            tables["orders"] = tables["orders"].withColumnRenamed("o_custkey", "c_custkey")
        spec = {"old_new_table_mapping": {"orders": "deal", "customer": "deal"}, "new_relevant_table": {"deal": "deal (o_orderkey int, c_acctbal real)"}, "query": sql}
        deal = benchmark.materialize(tables, {"op": "TABLE_MERGE", "spec": spec})["deal"]
        made.append(deal.agg(F.lit(case).alias("gold"), F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance")))
    return reduce(DataFrame.unionByName, made)


@query("SELECT c_custkey, coalesce(CAST(c_name AS VARCHAR), '') || ' ' || coalesce(CAST(c_mktsegment AS VARCHAR), '') AS label FROM customer")
def benchmark_column_merge(spark: SparkSession, t: Tables) -> DataFrame:
    """A merge of columns that only shows in the definitions before and after."""
    own = t["customer"].select("c_custkey", "c_name", "c_mktsegment")
    tables = {"relevant_table": {"customer": "customer (c_custkey int, c_name text, c_mktsegment text)"}, "new_relevant_table": {"customer": "customer (c_custkey int, label text)"}}
    item = {"op": "COLUMN_MERGE", "spec": tables}
    return benchmark.materialize({"customer": own}, item)["customer"].select("c_custkey", "label")


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000")
def benchmark_split(spark: SparkSession, t: Tables) -> DataFrame:
    """A split as an item describes it, and the old table joined again from its parts."""
    spec = {"old_new_table_column_mapping": {"customer": ["named", "money"]}, "new_relevant_table": {"named": {"columns": ["c_custkey", "c_name"]}, "money": "money (c_custkey int, c_acctbal real)"}}
    made = benchmark.materialize({"customer": t["customer"]}, {"op": "TABLE_SPLIT", "spec": spec})
    return made["named"].join(made["money"], "c_custkey").where("c_acctbal > 5000").select("c_custkey", "c_name")

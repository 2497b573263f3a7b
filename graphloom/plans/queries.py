"""Queries over the driver's tables as graphs, each with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import iri as I
from ..functions.terms import iri_is_valid, lexical_is_valid
from ..operators import canon, containers, dataset, graph, mapping, profile, traverse, vocab
from ..operators.graph import Literal
from ..schema import BLANK, COLUMNS, FIRST, INTEGER, IRI, LITERAL, NIL, RDF, RDFS, REST, STRING, TYPE, XSD
from ..sources import nquads
from ..storage import written
from .tables import BASE, SPECS, V, quads, quads_sql, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
ALL = ", ".join(COLUMNS)


def query(sql: str | None = None, *tables: str, graphs: bool = False) -> Callable[[Query], Query]:
    """Registers a query; ``sql`` may use q, the quads of ``tables``."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            head = f"q AS ({quads_sql(*tables, graphs=graphs)})" if tables else ""
            SQL[f.__name__] = (f"WITH RECURSIVE {head}{', ' if sql.startswith('+') else ' '}" if head else "") + sql.lstrip("+")
        return f

    return register


def _none(df: DataFrame) -> DataFrame:
    """Triples of the default graph from the columns s_kind .. o_lang."""
    return df.withColumn("g_kind", F.lit(None).cast("byte")).withColumn("g", F.lit(None).cast("string")).select(*COLUMNS)


# --- triples, patterns, projections -----------------------------------------


@query(f"SELECT {ALL} FROM q", "customer")
def triplify_customer(spark, d):
    return quads(spark, d, "customer")


@query(f"SELECT {ALL} FROM q WHERE p = '{V}c_name'", "customer")
def find_by_predicate(spark, d):
    return graph.match(quads(spark, d, "customer"), p=V + "c_name")


@query(f"SELECT {ALL} FROM q WHERE s IN ('{BASE}customer/1', '{BASE}customer/7', '{BASE}customer/999999')", "customer")
def find_by_subject_set(spark, d):
    return graph.match(quads(spark, d, "customer"), s_in=[f"{BASE}customer/{i}" for i in (1, 7, 999999)])


@query(f"SELECT {ALL} FROM q WHERE s = '{BASE}nation/3' AND p = '{V}n_regionkey' AND o_kind = 0 AND o = '{BASE}region/3'", "nation")
def find_spo(spark, d):
    return graph.match(quads(spark, d, "nation"), s=BASE + "nation/3", p=V + "n_regionkey", o=BASE + "region/3")


@query(f"SELECT {ALL} FROM q WHERE o_kind = 2 AND o = 'BUILDING' AND o_dt = '{STRING}' AND o_lang IS NULL", "customer")
def find_object_literal(spark, d):
    return graph.match(quads(spark, d, "customer"), o=Literal("BUILDING"))


@query(f"SELECT {ALL} FROM q WHERE false", "customer")
def find_empty_in(spark, d):
    return graph.match(quads(spark, d, "customer"), p_in=[])


@query(f"SELECT {ALL} FROM q WHERE p IN ('{V}c_name', '{V}c_acctbal', '{TYPE}')", "customer")
def find_union_single_and_in(spark, d):
    return graph.match(quads(spark, d, "customer"), p=V + "c_name", p_in=[V + "c_acctbal", TYPE])


@query(f"SELECT EXISTS(SELECT 1 FROM q WHERE p = '{V}c_mktsegment' AND o = 'BUILDING') AS found", "customer")
def has_triples_flag(spark, d):
    return graph.match(quads(spark, d, "customer"), p=V + "c_mktsegment", o=Literal("BUILDING")).limit(1).agg((F.count("*") > 0).alias("found"))


@query(f"SELECT {ALL} FROM q WHERE p = '{V}c_mktsegment' AND o = 'BUILDING' AND o_kind = 2", "customer")
def matching_chain(spark, d):
    return graph.match(graph.match(quads(spark, d, "customer"), p=V + "c_mktsegment"), o=Literal("BUILDING"))


@query(f"SELECT o_kind, o, o_dt, o_lang FROM q WHERE s = '{BASE}nation/3' AND p = '{V}n_name'", "nation")
def get_objects(spark, d):
    return graph.objects_of(quads(spark, d, "nation"), BASE + "nation/3", V + "n_name")


@query(f"SELECT s_kind, s FROM q WHERE p = '{V}c_nationkey' AND o = '{BASE}nation/3'", "customer")
def get_subjects(spark, d):
    return graph.subjects_of(quads(spark, d, "customer"), V + "c_nationkey", BASE + "nation/3")


@query("SELECT DISTINCT s_kind, s FROM q", "customer")
def distinct_subjects(spark, d):
    return graph.subjects(quads(spark, d, "customer"))


@query("SELECT DISTINCT p FROM q", "customer", "orders")
def distinct_predicates(spark, d):
    return graph.predicates(quads(spark, d, "customer", "orders"))


@query("SELECT DISTINCT o_kind, o, o_dt, o_lang FROM q", "customer")
def distinct_objects(spark, d):
    return graph.objects(quads(spark, d, "customer"))


# --- set algebra -------------------------------------------------------------


@query(f"SELECT {ALL} FROM q UNION SELECT {ALL} FROM q WHERE s LIKE '%nation%'", "nation", "region")
def with_triples_dedup(spark, d):
    return graph.add(quads(spark, d, "nation", "region"), quads(spark, d, "nation"))


@query(f"SELECT {ALL} FROM q UNION ALL SELECT {ALL} FROM q", "nation")
def with_triples_bag(spark, d):
    return graph.add(quads(spark, d, "nation"), quads(spark, d, "nation"), dedup=False)


@query(f"SELECT {ALL} FROM q EXCEPT SELECT {ALL} FROM q WHERE p = '{V}n_name'", "nation")
def without_triples(spark, d):
    q = quads(spark, d, "nation")
    return graph.remove(q, graph.match(q, p=V + "n_name"))


@query(f"SELECT {ALL} FROM q WHERE NOT (s = '{BASE}customer/5' OR p = '{V}c_name' OR (o_kind = 2 AND o = 'BUILDING' AND o_dt IS NOT DISTINCT FROM '{STRING}'))", "customer")
def without_matching_or(spark, d):
    return graph.remove_matching(quads(spark, d, "customer"), s=BASE + "customer/5", p=V + "c_name", o=Literal("BUILDING"))


@query(f"SELECT DISTINCT {ALL} FROM q", "customer", "nation", "region")
def merge_graphs(spark, d):
    return graph.merge(quads(spark, d, "customer"), quads(spark, d, "nation", "region"))


@query(f"SELECT {ALL} FROM q WHERE s LIKE '{BASE}customer/%'", "customer", "nation")
def graph_difference(spark, d):
    return graph.remove(quads(spark, d, "customer", "nation"), quads(spark, d, "nation"))


@query(f"WITH a AS ({quads_sql('nation')}), b AS ({quads_sql('nation', 'region')}) SELECT side, count(*) AS n FROM (SELECT 2 AS side, * FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 1, * FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) GROUP BY side")
def graph_equality(spark, d):
    """Sides and counts of what two graphs don't share."""
    return graph.differences(quads(spark, d, "nation"), quads(spark, d, "nation", "region")).groupBy("side").agg(F.count("*").alias("n"))


@query("SELECT CAST(2 * count(*) AS BIGINT) AS size FROM q", "nation")
def graph_size(spark, d):
    """Triples of a bag, duplicates counted."""
    q = quads(spark, d, "nation")
    return graph.size(q.unionAll(q))


@query("SELECT count(*) AS size FROM (SELECT DISTINCT * FROM q)", "nation")
def graph_distinct_size(spark, d):
    q = quads(spark, d, "nation")
    return graph.graph_hash(q.unionAll(q)).select("size")


# --- datasets ----------------------------------------------------------------

_DATASET = ("customer", "nation", "region")


@query("SELECT DISTINCT g_kind, g FROM q", *_DATASET, graphs=True)
def graph_names(spark, d):
    return dataset.graph_names(quads(spark, d, *_DATASET, graphs=True))


@query(f"SELECT {ALL} FROM q WHERE g = '{BASE}g/nation'", *_DATASET, graphs=True)
def graph_lookup(spark, d):
    return dataset.graph(quads(spark, d, *_DATASET, graphs=True), BASE + "g/nation")


@query(f"+r AS ({quads_sql('region')}) SELECT {ALL} FROM q UNION ALL SELECT {ALL} FROM r", "nation", "customer", graphs=True)
def quads_flatten(spark, d):
    return quads(spark, d, "region").unionByName(quads(spark, d, "nation", "customer", graphs=True))


@query(f"SELECT CAST(0 AS TINYINT) AS g_kind, '{BASE}g/one' AS g, s_kind, s, p, o_kind, o, o_dt, o_lang FROM q", "region")
def from_graphs_last_wins(spark, d):
    one = lambda name, i: dataset.in_graph(quads(spark, d, name), BASE + "g/one").withColumn("i", F.lit(i))
    return dataset.from_graphs(one("nation", 1).unionByName(one("region", 2)), "i")


@query(f"SELECT {ALL}, 1 AS side FROM q WHERE s = '{BASE}nation/3'", *_DATASET, graphs=True)
def dataset_equality(spark, d):
    q = quads(spark, d, *_DATASET, graphs=True)
    return graph.differences(q, q.where(F.col("s") != BASE + "nation/3"))


@query("SELECT CAST(NULL AS TINYINT) AS g_kind, CAST(NULL AS VARCHAR) AS g, s_kind, s, p, o_kind, o, o_dt, o_lang FROM q", *_DATASET, graphs=True)
def merge_into_default(spark, d):
    return dataset.collapse(quads(spark, d, *_DATASET, graphs=True), "merge")


@query("SELECT g_kind, g, count(*) AS triples FROM q GROUP BY g_kind, g", *_DATASET, graphs=True)
def named_graphs(spark, d):
    return dataset.named_graphs(quads(spark, d, *_DATASET, graphs=True))


# --- traversal ---------------------------------------------------------------

_WORLD = ("orders", "customer", "nation", "region")
_REACH = "+walk(s, depth) AS (SELECT '{root}', 0 UNION SELECT q.o, depth + 1 FROM walk JOIN q USING (s) WHERE o_kind = 0 AND {descend}) SELECT DISTINCT {all}, CAST(depth AS INTEGER) AS depth FROM q JOIN walk USING (s) WHERE {emit}"


@query(_REACH.format(root=BASE + "orders/5", descend="true", emit="true", all=ALL), *_WORLD)
def subgraph_reach(spark, d):
    q = quads(spark, d, *_WORLD)
    return traverse.reach(q, traverse.iri_node([BASE + "orders/5"], q))


@query(_REACH.format(root=BASE + "orders/5", descend="true", emit="o_kind = 2", all=ALL), *_WORLD)
def subgraph_skip_but_descend(spark, d):
    q = quads(spark, d, *_WORLD)
    return traverse.reach(q, traverse.iri_node([BASE + "orders/5"], q), emit=F.col("o_kind") == LITERAL)


@query(_REACH.format(root=BASE + "orders/5", descend=f"p <> '{V}c_nationkey'", emit="true", all=ALL), *_WORLD)
def subgraph_no_descend(spark, d):
    q = quads(spark, d, *_WORLD)
    return traverse.reach(q, traverse.iri_node([BASE + "orders/5"], q), descend=F.col("p") != V + "c_nationkey")


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Line items as blank nodes below their orders."""
    rows = read(spark, d, "lineitem").select("l_orderkey", *[F.col(c).cast("decimal(18,2)").cast("string").alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")], F.col("l_partkey").cast("string").alias("l_partkey"), F.col("l_linenumber").cast("string").alias("l_linenumber"), "l_returnflag", F.date_format("l_shipdate", "yyyy-MM-dd").alias("l_shipdate"))
    node = F.concat(F.lit("li|"), F.md5(F.concat_ws("|", F.col("l_orderkey").cast("string"), "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate")))
    lit = lambda c: F.struct(F.lit(BLANK).cast("byte").alias("s_kind"), node.alias("s"), F.lit(V + c).alias("p"), F.lit(LITERAL).cast("byte").alias("o_kind"), F.col(c).alias("o"), F.lit(STRING).alias("o_dt"))
    link = F.struct(F.lit(IRI).cast("byte").alias("s_kind"), F.concat(F.lit(BASE + "orders/"), F.col("l_orderkey").cast("string")).alias("s"), F.lit(V + "item").alias("p"), F.lit(BLANK).cast("byte").alias("o_kind"), node.alias("o"), F.lit(None).cast("string").alias("o_dt"))
    return _none(rows.select(F.explode(F.array(link, lit("l_quantity"), lit("l_partkey"))).alias("t")).select("t.*").withColumn("o_lang", F.lit(None).cast("string")))


_ITEMS = f"""li AS (SELECT 'li|' || md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR), CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR), CAST(CAST(l_discount AS DECIMAL(18,2)) AS VARCHAR), CAST(CAST(l_tax AS DECIMAL(18,2)) AS VARCHAR), l_returnflag, strftime(l_shipdate, '%Y-%m-%d'))) AS node, * FROM lineitem),
i AS (SELECT CAST(NULL AS TINYINT) AS g_kind, CAST(NULL AS VARCHAR) AS g, CAST(0 AS TINYINT) AS s_kind, '{BASE}orders/' || l_orderkey AS s, '{V}item' AS p, CAST(1 AS TINYINT) AS o_kind, node AS o, CAST(NULL AS VARCHAR) AS o_dt, CAST(NULL AS VARCHAR) AS o_lang FROM li
UNION ALL SELECT NULL, NULL, CAST(1 AS TINYINT), node, '{V}l_quantity', CAST(2 AS TINYINT), CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR), '{STRING}', NULL FROM li
UNION ALL SELECT NULL, NULL, CAST(1 AS TINYINT), node, '{V}l_partkey', CAST(2 AS TINYINT), CAST(l_partkey AS VARCHAR), '{STRING}', NULL FROM li)"""


@query(f"+{_ITEMS.replace('FROM lineitem)', 'FROM lineitem WHERE l_orderkey IN (5, 6))')} SELECT {ALL} FROM q WHERE s IN ('{BASE}orders/5', '{BASE}orders/6') UNION ALL SELECT {ALL} FROM i", "orders")
def cbd_blank_closure(spark, d):
    q = quads(spark, d, "orders").unionByName(_items(spark, d))
    return traverse.describe(q, traverse.iri_node([BASE + "orders/5", BASE + "orders/6"], q))


@query("SELECT DISTINCT s_kind, s FROM q WHERE s NOT IN (SELECT o FROM q WHERE o_kind = 0)", *_WORLD)
def root_subjects(spark, d):
    return traverse.root_subjects(quads(spark, d, *_WORLD))


@query(f"WITH {_ITEMS} SELECT o AS node, count(*) AS uses FROM i WHERE o_kind = 1 GROUP BY o HAVING count(*) = 1")
def inline_blank_candidates(spark, d):
    return containers.inline_candidates(_items(spark, d))


@query(f"+e AS (SELECT s AS node, o AS need FROM q WHERE o_kind = 0 AND p <> '{TYPE}'), w(node, level) AS (SELECT DISTINCT need, 0 FROM e WHERE need NOT IN (SELECT node FROM e) UNION SELECT e.node, level + 1 FROM e JOIN w ON e.need = w.node) SELECT node, CAST(max(level) AS INTEGER) AS level FROM w GROUP BY node", *_WORLD)
def topological_levels(spark, d):
    """Orders above customers above nations above regions."""
    q = quads(spark, d, *_WORLD)
    return traverse.topological(q.where((F.col("o_kind") == IRI) & (F.col("p") != TYPE)).select(F.col("s").alias("node"), F.col("o").alias("need")))


@query("SELECT node, min(node) OVER (PARTITION BY grp) AS component FROM (SELECT 'n' || n_nationkey AS node, n_regionkey AS grp FROM nation UNION ALL SELECT 'r' || r_regionkey, r_regionkey FROM region)")
def connected_components(spark, d):
    """Nations and their regions: a component for each region."""
    pairs = read(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("a"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("b"))
    return traverse.connected(pairs)


_STEPS = "c AS (SELECT *, 'conv|' || conv_id || CASE WHEN n = 1 THEN '' ELSE '-' || (n - 1) END AS node, 'conv|' || conv_id || '-' || n AS nxt FROM (SELECT *, row_number() OVER w AS n, lead(1) OVER w AS more FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)))"


def _turns(spark: SparkSession, d: str, column: str) -> DataFrame:
    """Turns of conversations with their number ``n`` from 1, and a column as a string literal."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long")
    return read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("conv"), n.alias("n"), F.lit(LITERAL).cast("byte").alias("o_kind"), F.col(column).alias("o"), F.lit(STRING).alias("o_dt"), F.lit(None).cast("string").alias("o_lang"))


def _conversation_list(spark: SparkSession, d: str) -> DataFrame:
    return containers.list_quads(_turns(spark, d, "text").select(F.concat(F.lit("conv|"), "conv").alias("head"), (F.col("n") - 1).alias("position"), "o_kind", "o", "o_dt", "o_lang"))


@query(f"WITH {_STEPS} SELECT CAST(NULL AS TINYINT) AS g_kind, CAST(NULL AS VARCHAR) AS g, CAST(1 AS TINYINT) AS s_kind, node AS s, '{FIRST}' AS p, CAST(2 AS TINYINT) AS o_kind, text AS o, '{STRING}' AS o_dt, CAST(NULL AS VARCHAR) AS o_lang FROM c UNION ALL SELECT NULL, NULL, CAST(1 AS TINYINT), node, '{REST}', CAST(CASE WHEN more IS NULL THEN 0 ELSE 1 END AS TINYINT), CASE WHEN more IS NULL THEN '{NIL}' ELSE nxt END, NULL, NULL FROM c")
def rdf_list_build(spark, d):
    return _conversation_list(spark, d)


@query(f"SELECT 'conv|' || conv_id AS head, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS position, CAST(2 AS TINYINT) AS o_kind, text AS o, '{STRING}' AS o_dt, CAST(NULL AS VARCHAR) AS o_lang FROM conversations")
def rdf_list_read(spark, d):
    return traverse.list_items(_conversation_list(spark, d))


@query(f"WITH {_STEPS} SELECT node AS s, CAST(1 AS BIGINT) AS firsts, CAST(1 AS BIGINT) AS rests FROM c")
def list_node_candidates(spark, d):
    return traverse._list_nodes(_conversation_list(spark, d)).where("firsts = 1 and rests = 1").select("s", "firsts", "rests")


def _roles(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return containers.container_quads(_turns(spark, d, "role").select(F.lit(IRI).cast("byte").alias("s_kind"), F.concat(F.lit(BASE + "conv/"), "conv").alias("s"), F.col("n").alias("position"), "o_kind", "o", "o_dt", "o_lang"), kind)


@query(f"SELECT '{BASE}conv/' || conv_id AS s, '{RDF}_' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p, role AS o FROM conversations UNION ALL SELECT DISTINCT '{BASE}conv/' || conv_id, '{TYPE}', '{RDF}Seq' FROM conversations")
def rdf_seq_build(spark, d):
    return _roles(spark, d, "Seq").select("s", "p", "o")


@query(f"SELECT '{BASE}conv/' || conv_id AS s, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS position, role AS o FROM conversations WHERE turn <> 1")
def rdf_seq_read(spark, d):
    """Members by their numbers, after the second of each is taken out: gaps are skipped."""
    q = _roles(spark, d, "Seq")
    turns = read(spark, d, "conversations").where("turn = 1").select("conv_id").distinct()
    gone = turns.select(F.concat(F.lit(BASE + "conv/"), F.col("conv_id").cast("string")).alias("s"), F.lit(RDF + "_2").alias("p"))
    return containers.container_items(q.join(gone, ["s", "p"], "left_anti")).select("s", "position", "o")


@query(f"SELECT '{BASE}conv/' || conv_id AS s, role AS o, count(*) AS n FROM conversations GROUP BY ALL")
def rdf_bag_counts(spark, d):
    return containers.container_items(_roles(spark, d, "Bag"), "Bag").groupBy("s", "o").agg(F.count("*").alias("n"))


# --- canonical form ----------------------------------------------------------


def _event_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Events as blank nodes with two literals each."""
    rows = read(spark, d, "events")
    lit = lambda p, v: F.struct(F.lit(BLANK).cast("byte").alias("s_kind"), F.concat(F.lit("ev|e"), F.col("event_id").cast("string")).alias("s"), F.lit(V + p).alias("p"), F.lit(LITERAL).cast("byte").alias("o_kind"), v.alias("o"), F.lit(STRING).alias("o_dt"), F.lit(None).cast("string").alias("o_lang"))
    return _none(rows.select(F.explode(F.array(lit("event_type", F.col("event_type")), lit("user_id", F.col("user_id").cast("string")))).alias("t")).select("t.*"))


_EVENT_HASH = f"""e AS (SELECT 'ev|e' || event_id AS node, '_:a <{V}event_type> "' || event_type || '" .' || chr(10) AS x, '_:a <{V}user_id> "' || user_id || '" .' || chr(10) AS y FROM events), h AS (SELECT node, sha256(CASE WHEN x < y THEN x || y ELSE y || x END) AS hash FROM e)"""


@query(f"WITH {_EVENT_HASH} SELECT node, hash FROM h")
def first_degree_hash(spark, d):
    return canon.first_degree_hashes(_event_nodes(spark, d))


@query(f"WITH {_EVENT_HASH} SELECT hash, count(*) AS n FROM h GROUP BY hash HAVING count(*) > 1")
def blank_hash_collisions(spark, d):
    return canon.first_degree_hashes(_event_nodes(spark, d)).groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")


@query(f"WITH {_EVENT_HASH} SELECT node, hash, true AS settled FROM h WHERE hash IN (SELECT hash FROM h GROUP BY hash HAVING count(*) = 1)")
def unique_canonical_ids(spark, d):
    """Nodes that their own quads already tell apart from all others."""
    hashes = canon.first_degree_hashes(_event_nodes(spark, d))
    single = hashes.groupBy("hash").count().where("count = 1").select("hash")
    return hashes.join(single, "hash", "left_semi").select("node", "hash", F.lit(True).alias("settled"))


_EVENT_LINES = f"""{_EVENT_HASH}, k AS (SELECT node, count(*) OVER (PARTITION BY hash) AS n, hash FROM h),
r AS (SELECT node, row_number() OVER (ORDER BY n > 1, hash) - 1 AS id FROM k), named AS (SELECT events.*, id FROM r JOIN events ON node = 'ev|e' || event_id)
SELECT '_:c14n' || id || ' <{V}event_type> "' || event_type || '" .' AS value FROM named UNION ALL SELECT '_:c14n' || id || ' <{V}user_id> "' || user_id || '" .' FROM named"""


@query(f"WITH {_EVENT_LINES}")
def canon_event_lines(spark, d):
    """Nodes of unique hash come first, in the order of their hashes, then those that share one."""
    return canon.canonical_lines(_event_nodes(spark, d))


@query(f"WITH {_EVENT_LINES}")
def canon_relabelled_lines(spark, d):
    """The same lines from nodes that have other labels."""
    return canon.canonical_lines(_event_nodes(spark, d).withColumn("s", F.concat(F.lit("x|"), F.md5("s"))))


def _threads(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as chains of blank nodes, a turn each with its role, in the column ``conv``."""
    turns = _turns(spark, d, "role")
    node = lambda n: F.concat(F.lit("t|"), n.cast("string"))
    none, last = F.lit(None).cast("string"), F.max("n").over(Window.partitionBy("conv"))
    row = lambda p, kind, o, dt: F.struct(F.lit(V + p).alias("p"), F.lit(kind).cast("byte").alias("o_kind"), o.alias("o"), dt.alias("o_dt"))
    links = F.array(row("role", LITERAL, F.col("o"), F.lit(STRING)), F.when(F.col("n") < last, row("next", BLANK, node(F.col("n") + 1), none)))
    rows = turns.select("conv", F.lit(BLANK).cast("byte").alias("s_kind"), node(F.col("n")).alias("s"), F.array_compact(links).alias("links"))
    return rows.select("conv", "s_kind", "s", F.explode("links").alias("t")).select("conv", F.lit(None).cast("byte").alias("g_kind"), none.alias("g"), "s_kind", "s", "t.*", none.alias("o_lang"))


@query("WITH r AS (SELECT CAST(conv_id AS VARCHAR) AS conv, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id) SELECT conv, min(conv) OVER (PARTITION BY roles) AS same FROM r")
def canon_conversation_classes(spark, d):
    """Conversations whose graphs are the same but for labels: those with the same roles in the same order; nodes of one role are tied and related."""
    return canon.isomorphism_classes(_threads(spark, d), "conv").select("conv", "same")


@query(f"""WITH h AS (SELECT CAST(conv_id AS VARCHAR) AS conv, sha256(string_agg(line, '' ORDER BY line)) AS hash FROM (
  SELECT conv_id, turn, unnest([CASE WHEN up THEN '_:z <{V}next> _:a .' || chr(10) END, CASE WHEN down THEN '_:a <{V}next> _:z .' || chr(10) END, '_:a <{V}role> "' || role || '" .' || chr(10)]) AS line
  FROM (SELECT *, lag(1) OVER w IS NOT NULL AS up, lead(1) OVER w IS NOT NULL AS down FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))) WHERE line IS NOT NULL GROUP BY conv_id, turn)
SELECT conv, count(*) AS nodes, count(DISTINCT hash) AS kinds FROM h GROUP BY conv""")
def canon_thread_nodes(spark, d):
    """Blank nodes of every conversation, all with an identifier of their own, and how many kinds of first-degree hashes they have."""
    q = _threads(spark, d)
    ids = canon.canonical_ids(q, by="conv").groupBy("conv").agg(F.countDistinct("id").alias("nodes"))
    kinds = canon.first_degree_hashes(q.withColumn("s", F.concat("conv", F.lit("|"), "s")).withColumn("o", F.when(F.col("o_kind") == BLANK, F.concat("conv", F.lit("|"), "o")).otherwise(F.col("o"))))
    return ids.join(kinds.groupBy(F.substring_index("node", "|", 1).alias("conv")).agg(F.countDistinct("hash").alias("kinds")), "conv")


@query("SELECT true AS same, false AS less FROM (SELECT count(*) AS n FROM nation) WHERE n > 0")
def canon_isomorphic_relabel(spark, d):
    """Nations as blank nodes below their regions: against a relabelled copy, and against one with a nation less."""
    q = quads(spark, d, "nation").withColumn("s_kind", F.lit(BLANK).cast("byte"))
    less = q.where(F.col("s") != BASE + "nation/3")
    one, two, less = (t.withColumn("s", F.concat(F.lit("a|"), label)) for t, label in ((q, F.col("s")), (q, F.md5("s")), (less, F.md5("s"))))
    return spark.createDataFrame([(canon.isomorphic(one, two), canon.isomorphic(one, less))], "same boolean, less boolean")


# --- line formats ------------------------------------------------------------

_LINE = """'<' || s || '> <' || p || '> ' || CASE WHEN o_kind = 0 THEN '<' || o || '>' WHEN o_dt = 'http://www.w3.org/2001/XMLSchema#string' THEN '"' || replace(replace(replace(o, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n') || '"' ELSE '"' || o || '"^^<' || o_dt || '>' END"""


@query(f"SELECT {_LINE} || ' <' || g || '> .' AS value FROM q", "part", "orders", graphs=True)
def nquads_encode(spark, d):
    return nquads.lines(quads(spark, d, "part", "orders", graphs=True))


@query(f"SELECT DISTINCT {_LINE} || ' .' AS value FROM q", "nation", "region")
def nquads_canonical_lines(spark, d):
    q = quads(spark, d, "nation", "region")
    return nquads.lines(q.unionAll(q), canonical=True)


@query(f"SELECT {ALL} FROM q", "customer", "events", graphs=True)
def nquads_roundtrip(spark, d):
    q = quads(spark, d, "customer", "events", graphs=True)
    return nquads.checked(nquads.parse_lines(nquads.lines(q)))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), r AS (SELECT doc_id, trim(line, ' ') AS t FROM l WHERE trim(line, ' ') <> '' AND NOT starts_with(trim(line, ' '), '#'))
SELECT doc_id, avg(CASE WHEN (starts_with(t, '<') OR starts_with(t, '_:')) AND ends_with(t, '.') AND len(string_split(t, ' ')) >= 3 THEN 1.0 ELSE 0.0 END) AS share, avg(CASE WHEN (starts_with(t, '<') OR starts_with(t, '_:')) AND ends_with(t, '.') AND len(string_split(t, ' ')) >= 3 THEN 1.0 ELSE 0.0 END) > 0.8 AS can_parse FROM r GROUP BY doc_id""")
def nquads_can_parse_ratio(spark, d):
    return nquads.can_parse(read(spark, d, "documents"), "text", "doc_id")


# --- objects -----------------------------------------------------------------


@query(f"SELECT '{BASE}customer/' || c_custkey AS s, CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, CAST(c_acctbal AS DECIMAL(18,2)) AS c_acctbal, c_mktsegment FROM customer")
def project_customer(spark, d):
    return mapping.project(quads(spark, d, "customer"), SPECS["customer"])


@query(f"SELECT '{BASE}orders/' || o_orderkey AS s, CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def project_nested_order(spark, d):
    """Orders with their customer and the customer's nation, from one graph."""
    q = quads(spark, d, "orders", "customer", "nation")
    order, customer, nation = (mapping.project(q, SPECS[t]) for t in ("orders", "customer", "nation"))
    inner = customer.join(nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey").select(F.col("c_custkey").alias("o_custkey"), "c_name", "n_name")
    return order.join(inner, "o_custkey").select("s", "o_totalprice", "c_name", "n_name")


@query(f"SELECT '{BASE}customer/' || c_custkey AS s, CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS c_mktsegment FROM customer")
def project_optional(spark, d):
    """A property that some subjects lack is null there."""
    spec = SPECS["customer"]
    some = graph.remove_matching(quads(spark, d, "customer"), o=Literal("BUILDING"))
    return mapping.project(some, spec).select("s", "c_custkey", "c_mktsegment")


@query(f"SELECT '{BASE}customer/' || o_custkey AS s, array_to_string(list(CAST(o_orderkey AS VARCHAR) ORDER BY CAST(o_orderkey AS VARCHAR)), ',') AS orders FROM orders GROUP BY o_custkey")
def project_multi(spark, d):
    """All values of a property that has many."""
    spec = mapping.ClassSpec(V + "Customer", BASE + "customer/{}", "c_custkey", (mapping.Property("orders", V + "placed", "iri", BASE + "orders/{}", many=True),))
    placed = quads(spark, d, "orders").where(F.col("p") == V + "o_custkey").select("g_kind", "g", F.col("o_kind").alias("s_kind"), F.col("o").alias("s"), F.lit(V + "placed").alias("p"), F.col("s_kind").alias("o_kind"), F.col("s").alias("o"), "o_dt", "o_lang")
    return mapping.project(quads(spark, d, "customer").unionByName(placed), spec).where(F.size("orders") > 0).select("s", F.array_join("orders", ",").alias("orders"))


_STRICT = mapping.ClassSpec(V + "Customer", BASE + "customer/{}", "c_custkey", (mapping.Property("c_name", V + "c_name", required=True), mapping.Property("c_acctbal", V + "c_acctbal", "integer"), mapping.Property("phone", V + "phone", required=True)))


def _violations(spark: SparkSession, d: str, problem: str) -> DataFrame:
    q = quads(spark, d, "customer")
    second = q.where((F.col("p") == V + "c_name") & F.col("o").endswith("7")).withColumn("o", F.concat("o", F.lit(" II")))
    return mapping.violations(q.unionByName(second), _STRICT).where(F.col("problem") == problem)


@query(f"SELECT '{BASE}customer/' || c_custkey AS s, '{V}c_name' AS predicate, 'too many values' AS problem, CAST(2 AS BIGINT) AS n FROM customer WHERE c_name LIKE '%7'")
def too_many_values(spark, d):
    return _violations(spark, d, "too many values")


@query(f"SELECT '{BASE}customer/' || c_custkey AS s, '{V}c_acctbal' AS predicate, 'datatype' AS problem, CAST(1 AS BIGINT) AS n FROM customer")
def datatype_mismatch(spark, d):
    return _violations(spark, d, "datatype")


@query(f"SELECT '{BASE}customer/' || c_custkey AS s, '{V}phone' AS predicate, 'missing' AS problem, CAST(0 AS BIGINT) AS n FROM customer")
def missing_required(spark, d):
    return _violations(spark, d, "missing")


@query(f"SELECT {ALL} FROM q WHERE s LIKE '{BASE}nation/%' OR p IN ('{V}c_nationkey', '{V}c_mktsegment')", "customer", "nation")
def unmapped_remainder(spark, d):
    return mapping.unmapped(quads(spark, d, "customer", "nation"), _STRICT)


@query(f"SELECT s, array_to_string(list(p || '=' || os ORDER BY p), ';') AS fields FROM (SELECT s, p, array_to_string(list(o ORDER BY o), ',') AS os FROM q GROUP BY s, p) GROUP BY s", "nation")
def predicates_map(spark, d):
    entries = F.transform(F.map_entries("values"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ",")))
    return mapping.predicates_map(quads(spark, d, "nation")).select("s", F.array_join(entries, ";").alias("fields"))


# --- IRIs and literals -------------------------------------------------------


@query("SELECT page_id, nullif(regexp_extract(url, '^(https?)://([^/]*)/(.*)$', 1), '') AS scheme, CASE WHEN regexp_matches(url, '^(https?)://([^/]*)/(.*)$') THEN regexp_extract(url, '^(https?)://([^/]*)/(.*)$', 2) END AS host, CASE WHEN regexp_matches(url, '^(https?)://([^/]*)/(.*)$') THEN regexp_extract(url, '^(https?)://([^/]*)/(.*)$', 3) END AS rest FROM pages")
def iri_template_extract(spark, d):
    found = I.from_template(F.col("url"), "{scheme}://{host}/{+rest}")
    return read(spark, d, "pages").select("page_id", *[c.alias(n) for n, c in found.items()])


@query("SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)/?$', 1) AS last FROM pages")
def last_path_element(spark, d):
    return read(spark, d, "pages").select("page_id", I.last_path_element(F.col("url")).alias("last"))


@query("SELECT page_id, CASE WHEN contains(url, '#') THEN substr(url, strpos(url, '#') + 1) END AS frag FROM pages")
def fragment_element(spark, d):
    return read(spark, d, "pages").select("page_id", I.fragment(F.col("url")).alias("frag"))


@query("+n AS (SELECT DISTINCT p AS iri FROM q UNION SELECT DISTINCT o FROM q WHERE o_kind = 0), l AS (SELECT iri, regexp_extract(iri, '[/#]([^/#]*)$', 1) AS loc FROM n) SELECT iri, substr(iri, 1, length(iri) - length(loc)) AS ns, loc FROM l", "customer", "orders")
def iri_namespace_split(spark, d):
    q = quads(spark, d, "customer", "orders")
    iris = q.select(F.col("p").alias("iri")).union(q.where(F.col("o_kind") == IRI).select("o")).distinct()
    return iris.select("iri", I.namespace(F.col("iri")).alias("ns"), I.local_name(F.col("iri")).alias("loc"))


@query(f"SELECT DISTINCT p, CASE WHEN starts_with(p, '{V}') THEN 'v:' || substr(p, {len(V) + 1}) WHEN starts_with(p, '{RDF}') THEN 'rdf:' || substr(p, {len(RDF) + 1}) ELSE p END AS name FROM q", "customer", "orders", "part")
def iri_prefix_compact(spark, d):
    return graph.predicates(quads(spark, d, "customer", "orders", "part")).select("p", I.compact(F.col("p"), {"v": V, "d": BASE, **I.PREFIXES}).alias("name"))


@query("SELECT page_id, regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+.-]*:') AND NOT contains(url, ' ') AS valid FROM pages UNION ALL SELECT doc_id, regexp_matches(text, '^[a-zA-Z][a-zA-Z0-9+.-]*:') AND NOT contains(text, ' ') FROM documents")
def iri_validate(spark, d):
    rows = read(spark, d, "pages").select("page_id", "url").union(read(spark, d, "documents").select("doc_id", "text"))
    return rows.select("page_id", iri_is_valid(F.col("url")).alias("valid"))


@query("SELECT o_kind, o_dt, count(*) AS n FROM q GROUP BY ALL", "customer", "orders", "part", "events")
def literal_kind_counts(spark, d):
    return quads(spark, d, "customer", "orders", "part", "events").groupBy("o_kind", "o_dt").agg(F.count("*").alias("n"))


@query(f"SELECT s, p, CASE WHEN o_dt = '{INTEGER}' THEN TRY_CAST(o AS BIGINT) END AS i, CASE WHEN o_dt = '{XSD}decimal' THEN TRY_CAST(o AS DECIMAL(18,2)) END AS n, CASE WHEN o_dt = '{STRING}' THEN o END AS t FROM q WHERE o_kind = 2", "part")
def native_types(spark, d):
    return mapping.native_values(quads(spark, d, "part"))


@query("SELECT o, count(DISTINCT g) AS graphs FROM q WHERE o_kind = 0 GROUP BY o HAVING count(DISTINCT g) > 1", "customer", "supplier", "nation", graphs=True)
def cross_graph_objects(spark, d):
    return dataset.cross_graph_objects(quads(spark, d, "customer", "supplier", "nation", graphs=True))


@query(f"SELECT DISTINCT s, CASE WHEN s LIKE '{BASE}nation/%' THEN 'relative' ELSE 'prefixed' END AS kind, CASE WHEN s LIKE '{BASE}nation/%' THEN NULL ELSE 'c' END AS prefix, regexp_extract(s, '[^/]*$') AS text FROM q", "customer", "nation")
def iri_compact_roles(spark, d):
    """Subjects below the base and below a prefix."""
    found = graph.subjects(quads(spark, d, "customer", "nation")).select("s", I.compact_parts(F.col("s"), {"c": BASE + "customer/"}, "subject", BASE + "nation/").alias("c"))
    return found.select("s", "c.kind", "c.prefix", "c.text")


@query(f"SELECT * FROM (VALUES ('data', '{V}'), ('rdf', '{RDF}'), ('xsd', '{XSD}')) AS t(prefix, ns) WHERE ns = '{RDF}' OR ns IN (SELECT left(p, {len(V)}) FROM q UNION SELECT left(o_dt, {len(XSD)}) FROM q)", "orders")
def iri_generate_prefixes(spark, d):
    """Known prefixes, and one made for the vocabulary of the tables."""
    return spark.createDataFrame(sorted(I.prefixes_for(quads(spark, d, "orders")).items()), "prefix string, ns string")


# --- reification, profile, vocabulary ----------------------------------------


def _reified(spark: SparkSession, d: str) -> DataFrame:
    return containers.reify(quads(spark, d, "nation"), F.concat(F.lit(BASE + "st/"), F.md5(F.concat_ws(" ", "s", "p", "o"))))


_REIFY = f"st AS (SELECT '{BASE}st/' || md5(concat_ws(' ', s, p, o)) AS st, * FROM q), r AS (SELECT st AS s, '{TYPE}' AS p, CAST(0 AS TINYINT) AS o_kind, '{RDF}Statement' AS o, CAST(NULL AS VARCHAR) AS o_dt FROM st UNION ALL SELECT st, '{RDF}subject', s_kind, s, NULL FROM st UNION ALL SELECT st, '{RDF}predicate', CAST(0 AS TINYINT), p, NULL FROM st UNION ALL SELECT st, '{RDF}object', o_kind, o, o_dt FROM st)"


@query(f"+{_REIFY} SELECT s, p, o_kind, o, o_dt FROM r", "nation")
def reification_expand(spark, d):
    return _reified(spark, d).select("s", "p", "o_kind", "o", "o_dt")


@query("SELECT s, p, o_kind, o, o_dt FROM q", "nation")
def reification_detect(spark, d):
    """Statements put together again from their four triples."""
    return containers.statements(_reified(spark, d)).select("s", "p", "o_kind", "o", "o_dt")


_IRIS = "iris AS (SELECT DISTINCT unnest([CASE WHEN s_kind = 0 THEN s END, p, CASE WHEN o_kind = 0 THEN o END, o_dt]) AS iri FROM q), pre AS (SELECT iri, CASE WHEN contains(iri, '#') THEN regexp_extract(iri, '^(.*#)', 1) WHEN contains(iri, '/') THEN regexp_extract(iri, '^(.*/)', 1) ELSE iri END AS prefix FROM iris WHERE iri IS NOT NULL)"


@query(f"+{_IRIS} SELECT count(*) AS triples, count(DISTINCT s) AS subjects, count(DISTINCT p) AS predicates, (SELECT count(*) FROM (SELECT DISTINCT o_kind, o, o_dt, o_lang FROM q)) AS objects, CAST(count(*) FILTER (o_kind = 2) AS BIGINT) AS literals, (SELECT count(*) FROM pre) AS iris, (SELECT count(DISTINCT prefix) FROM pre) AS prefixes, CAST(0 AS BIGINT) AS blanks FROM q", "customer", "orders", "nation")
def graph_profile(spark, d):
    return profile.profile(quads(spark, d, "customer", "orders", "nation"))


@query(f"+{_IRIS} SELECT prefix, count(*) AS iris FROM pre GROUP BY prefix ORDER BY iris DESC, prefix LIMIT 5", "customer", "orders", "nation")
def top_prefixes(spark, d):
    return profile.top_prefixes(quads(spark, d, "customer", "orders", "nation"))


def _hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Customers below nations below regions, as classes."""
    q = quads(spark, d, "customer", "nation")
    return q.where(F.col("p").isin(V + "c_nationkey", V + "n_regionkey")).withColumn("p", F.lit(RDFS + "subClassOf"))


_CLOSURE = f"+e AS (SELECT s AS a, o AS b FROM q WHERE p IN ('{V}c_nationkey', '{V}n_regionkey')), c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a)"


@query(f"{_CLOSURE} SELECT a, b FROM c", "customer", "nation")
def class_closure(spark, d):
    return vocab.class_closure(_hierarchy(spark, d))


@query(f"{_CLOSURE}, x AS (SELECT a, b FROM c UNION SELECT a, a FROM c UNION SELECT b, b FROM c) SELECT DISTINCT a AS class, '{V}ofRegion' AS property FROM x WHERE b LIKE '{BASE}region/%' UNION SELECT DISTINCT a, '{V}ofNation' FROM x WHERE b LIKE '{BASE}nation/%'", "customer", "nation")
def class_properties(spark, d):
    h = _hierarchy(spark, d)
    tops = h.select(F.col("o").alias("o")).distinct()
    domains = tops.select(F.lit(None).cast("byte").alias("g_kind"), F.lit(None).cast("string").alias("g"), F.lit(IRI).cast("byte").alias("s_kind"), F.when(F.col("o").contains("/region/"), V + "ofRegion").otherwise(V + "ofNation").alias("s"), F.lit(RDFS + "domain").alias("p"), F.lit(IRI).cast("byte").alias("o_kind"), "o", F.lit(None).cast("string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"))
    return vocab.class_properties(domains, vocab.class_closure(h))


@query(f"SELECT iri, CASE WHEN max(k) = 1 THEN 'property' ELSE 'other' END AS kind FROM (SELECT DISTINCT p AS iri, 1 AS k FROM q UNION ALL SELECT DISTINCT o, 0 FROM q WHERE o_kind = 0) WHERE starts_with(iri, '{V}') GROUP BY iri", "customer", "orders")
def vocab_classify(spark, d):
    return vocab.classify(quads(spark, d, "customer", "orders"), V)


@query("WITH o AS (SELECT unnest(['c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) AS name) SELECT '" + V + "' || name AS s, '" + RDFS + "domain' AS p, '" + V + "Customer' AS o FROM o UNION ALL SELECT '" + V + "' || name, '" + RDFS + "isDefinedBy', '" + V + "' FROM o UNION ALL SELECT '" + V + "' || name, '" + TYPE + "', '" + RDF + "Property' FROM o")
def owl_ontology_build(spark, d):
    """Ontology triples of a class specification."""
    return vocab.ontology(SPECS["customer"], V, spark)


_TOP = f"{BASE}region/1"


@query(f"{_CLOSURE} SELECT b AS class, a AS subtype FROM c WHERE b = '{_TOP}'", "customer", "nation")
def class_subtypes(spark, d):
    return vocab.subtypes(_hierarchy(spark, d), [_TOP])


def _vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Nations as classes below regions, with labels, and a property for every second of them; part of the properties have no domain."""
    n = read(spark, d, "nation")
    iri = lambda kind: F.concat(F.lit(V + kind), F.col("n_nationkey").cast("string"))
    none = F.lit(None).cast("string")
    row = lambda s, p, o, dt=none: F.struct(F.lit(IRI).cast("byte").alias("s_kind"), s.alias("s"), F.lit(p).alias("p"), F.when(dt.isNull(), IRI).otherwise(LITERAL).cast("byte").alias("o_kind"), o.alias("o"), dt.alias("o_dt"), none.alias("o_lang"))
    up = F.concat(F.lit(V + "r"), F.col("n_regionkey").cast("string"))
    domain = F.when(F.col("n_nationkey") % 2 == 0, row(iri("p"), vocab.DOMAIN, up))
    rows = F.array(row(iri("n"), vocab.SUBCLASS, up), row(iri("n"), vocab.LABEL, F.col("n_name"), F.lit(STRING)), row(iri("p"), TYPE, F.lit(RDF + "Property")), domain)
    return _none(n.select(F.explode(F.array_compact(rows)).alias("t")).select("t.*"))


@query(f"SELECT '{V}n' || n_nationkey AS iri, n_name AS label, '{V}r' || n_regionkey AS superclass FROM nation")
def vocab_terms(spark, d):
    found = vocab.terms(_vocabulary(spark, d), V)
    return found.where(F.size("labels") > 0).select("iri", F.array_join("labels", ",").alias("label"), F.array_join("superclasses", ",").alias("superclass"))


@query(f"""WITH cls AS (SELECT '{V}n' || n_nationkey AS class, n_regionkey AS r FROM nation UNION SELECT '{V}r' || n_regionkey, n_regionkey FROM nation)
SELECT class, '{V}p' || n_nationkey AS property, 'own' AS origin FROM cls JOIN nation ON r = n_regionkey WHERE n_nationkey % 2 = 0 UNION ALL SELECT class, '{V}p' || n_nationkey, 'universal' FROM cls, nation WHERE n_nationkey % 2 = 1""")
def properties_for_classes(spark, d):
    q = _vocabulary(spark, d)
    return vocab.properties_for_classes(q, vocab.class_closure(q))


@query(f"SELECT '{V}' AS namespace, CAST((SELECT count(*) FROM nation) + (SELECT count(*) FROM nation WHERE n_nationkey % 2 = 0) AS BIGINT) AS uses FROM range(1)")
def referenced_namespaces(spark, d):
    from ..schema import RDFS as R

    return vocab.referenced_namespaces(_vocabulary(spark, d), [R, RDF])


@query("+t AS (SELECT DISTINCT s_kind, s, p, o_kind, o, o_dt, o_lang FROM q), i AS (SELECT DISTINCT unnest([s, p, CASE WHEN o_kind = 0 THEN o END]) AS iri FROM t) SELECT (SELECT count(*) FROM t) AS triples, (SELECT count(DISTINCT s) FROM t) AS subjects, (SELECT count(DISTINCT p) FROM t) AS predicates, (SELECT count(*) FROM t WHERE o_kind = 2) AS literals, (SELECT count(*) FROM i WHERE iri IS NOT NULL) AS iris, (SELECT count(DISTINCT CASE WHEN contains(iri, '#') THEN regexp_extract(iri, '^(.*#)', 1) ELSE regexp_extract(iri, '^(.*/)', 1) END) FROM i WHERE iri IS NOT NULL) AS prefixes, (SELECT count(DISTINCT g) FROM q) AS graphs FROM range(1)", *_DATASET, graphs=True)
def dataset_profile(spark, d):
    return profile.dataset_profile(quads(spark, d, *_DATASET, graphs=True))


@query(f"SELECT n_name AS name, CASE WHEN n_nationkey % 5 = 0 THEN 'vanished' ELSE 'renamed' END AS problem, CASE WHEN n_nationkey % 2 = 0 THEN 'error' ELSE 'info' END AS level FROM nation WHERE n_nationkey % 5 = 0 OR n_nationkey % 3 = 0")
def vocab_lock_diff(spark, d):
    n = read(spark, d, "nation")
    old = n.select(F.col("n_name").alias("name"), F.concat(F.lit(V), "n_name").alias("iri"), (F.col("n_nationkey") % 2 == 0).alias("auto"))
    new = n.where("n_nationkey % 5 <> 0").select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit(V + "new/"), "n_name")).otherwise(F.concat(F.lit(V), "n_name")).alias("iri"))
    return vocab.lock_diff(old, new)


@query(f"SELECT '{BASE}events/' || event_id AS s, '{V}' || k AS p, props ->> k AS o, CASE WHEN regexp_matches(props ->> k, '^-?[0-9]+$') THEN '{INTEGER}' ELSE '{STRING}' END AS o_dt FROM (SELECT *, unnest(json_keys(props)) AS k FROM events)")
def event_json_to_triples(spark, d):
    return mapping.json_triples(read(spark, d, "events"), F.concat(F.lit(BASE + "events/"), F.col("event_id").cast("string")), "props", V)


@query("SELECT page_id, regexp_replace(url, '#.*$', '') || '#f' AS frag, regexp_replace(url, '[?#].*$', '') || '?y' AS query, regexp_extract(url, '^[a-z]+://[^/?#]*') || '/g/' AS root FROM pages")
def iri_resolve(spark, d):
    """References against the address of every page."""
    of = lambda reference: I.resolve(F.lit(reference), F.col("url"))
    return read(spark, d, "pages").select("page_id", of("#f").alias("frag"), of("?y").alias("query"), of("/x/.././g/h/..").alias("root"))


@query("SELECT page_id, url AS back, true AS shorter FROM pages")
def iri_relativize(spark, d):
    """Addresses written relative to a page beside them: shorter, and the same when resolved."""
    base = F.concat(F.regexp_extract("url", "^[^?#]*/", 0), F.lit("beside.html"))
    short = read(spark, d, "pages").select("page_id", "url", base.alias("base"), I.relativize(F.col("url"), base).alias("short"))
    return short.select("page_id", I.resolve(F.col("short"), F.col("base")).alias("back"), (F.length("short") < F.length("url")).alias("shorter"))


# --- documents ---------------------------------------------------------------


def _tasks(spark: SparkSession) -> int:
    """Documents to write, so that all tasks read them: a number of its own is not drawn together."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@query(f"SELECT {ALL} FROM q", "customer", "part")
def turtle_roundtrip(spark, d):
    """Written as Turtle documents and read back."""
    from ..sources import turtle

    q = quads(spark, d, "customer", "part")
    return turtle.parse_documents(turtle.documents(q, {"v": V, "c": BASE + "customer/", **I.PREFIXES}, _tasks(spark)), graphs=False)


@query(f"""WITH o AS (SELECT '{BASE}orders/' || o_orderkey AS s, * FROM orders)
SELECT s, '{TYPE}' AS p, '{V}Order' AS o, NULL AS o_dt, NULL AS o_lang FROM o UNION ALL SELECT s, '{V}o_totalprice', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), '{XSD}decimal', NULL FROM o
UNION ALL SELECT s, '{V}note', o_orderstatus || ' .' || chr(10) || '@prefix v: <http://other/> .' || chr(10) || '"' || o_orderpriority || '"' || chr(9), '{RDF}langString', 'en' FROM o
UNION ALL SELECT s, '{V}o_custkey', '{BASE}customer/' || o_custkey, NULL, NULL FROM o UNION ALL SELECT s, '{V}o_orderdate', strftime(o_orderdate, '%Y-%m-%d'), '{XSD}date', NULL FROM o UNION ALL SELECT s, '{V}rank', CAST(o_orderkey % 7 AS VARCHAR), '{INTEGER}', NULL FROM o""")
def turtle_files(spark, d):
    """Turtle as another program writes it: prefixes in between, comments, dots within long strings, nodes and lists in place; read in slices."""
    import uuid

    from ..sources import turtle
    from ..storage import scratch_dir

    o = read(spark, d, "orders")
    key, price = F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    parts = ["PREFIX x: <" + XSD + ">\n@prefix v: <" + V + "> . # . \"\"\" \n@base <" + BASE + "> .\n<orders/", key, ">a v:Order;v:o_totalprice ", price, " ;\n\tv:note \"\"\"", F.col("o_orderstatus"), " .\n@prefix v: <http://other/> .\n\\\"", F.col("o_orderpriority"), "\\\"\\t\"\"\"@en;\n v:of [ v:o_custkey <customer/", F.col("o_custkey").cast("string"), "> ; v:o_orderdate '", F.date_format("o_orderdate", "yyyy-MM-dd"), "'^^x:date ] ; v:ranks ( ", (F.col("o_orderkey") % 7).cast("string"), " ).\n"]
    path = f"{scratch_dir(spark)}/turtle-{uuid.uuid4().hex}"
    o.select(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])).write.text(path)
    back = written(turtle.read(spark, path, graphs=False), "turtle-read")
    plain = ["s", "p", "o", "o_dt", "o_lang"]
    own = back.where((F.col("s_kind") == IRI) & ~F.col("p").isin(V + "of", V + "ranks")).select(*plain)
    below = lambda p: back.where(F.col("p") == V + p).select(F.col("o").alias("node"), F.col("s").alias("top"))
    inner = back.join(below("of"), F.col("s") == F.col("node")).select(F.col("top").alias("s"), *plain[1:])
    ranks = back.where(F.col("p") == FIRST).join(below("ranks"), F.col("s") == F.col("node")).select(F.col("top").alias("s"), F.lit(V + "rank").alias("p"), *plain[2:])
    return own.unionByName(inner).unionByName(ranks)


@query(f"SELECT '{BASE}conv/' || conv_id AS s, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS position, text AS o, '{BASE}conv/' || conv_id || '#' AS note FROM conversations")
def turtle_nested_roundtrip(spark, d):
    """Lists and notes written in place below their conversations, and read back."""
    from ..sources import turtle

    q = _conversation_list(spark, d)
    heads = read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("c")).distinct()
    conv, note = F.concat(F.lit(BASE + "conv/"), "c"), F.concat(F.lit("note|"), "c")
    none = F.lit(None).cast("string")
    row = lambda kind, s, p, o_kind, o, dt=none: F.struct(F.lit(kind).cast("byte").alias("s_kind"), s.alias("s"), F.lit(V + p).alias("p"), F.lit(o_kind).cast("byte").alias("o_kind"), o.alias("o"), dt.alias("o_dt"), none.alias("o_lang"))
    links = F.array(row(IRI, conv, "turns", BLANK, F.concat(F.lit("conv|"), "c")), row(IRI, conv, "note", BLANK, note), row(BLANK, note, "of", LITERAL, F.concat(conv, F.lit("#")), F.lit(STRING)))
    docs = turtle.documents(q.unionByName(_none(heads.select(F.explode(links).alias("t")).select("t.*"))), {"v": V}, _tasks(spark), nested=True, base=BASE)
    # read once: nodes in place are named after their documents, and these are cut anew whenever they are written
    back = written(turtle.parse_documents(docs, graphs=False, scope="nested"), "turtle-read")
    turns, notes = (back.where(F.col("p") == V + p).select("s", F.col("o").alias("node")) for p in ("turns", "note"))
    items = traverse.list_items(back).select(F.col("head").alias("node"), "position", "o").join(turns, "node").drop("node")
    return items.join(notes.join(back.where(F.col("p") == V + "of").select(F.col("s").alias("node"), F.col("o").alias("note")), "node").select("s", "note"), "s").select("s", "position", "o", "note")


@query(f"SELECT {ALL} FROM q", "customer", "nation", "events", graphs=True)
def trig_roundtrip(spark, d):
    from ..sources import turtle

    return turtle.parse_documents(turtle.documents(quads(spark, d, "customer", "nation", "events", graphs=True), {"v": V}, _tasks(spark)))


@query(f"SELECT {ALL} FROM q", "customer", "part", graphs=True)
def jsonld_roundtrip(spark, d):
    """Written as node objects, one per line, and read back."""
    from ..sources import jsonld

    return jsonld.parse_documents(jsonld.documents(quads(spark, d, "customer", "part", graphs=True)).withColumn("doc", F.lit("d")))


_OBJECT = f"""'{{{{"@id":"{BASE}orders/' || o_orderkey || '","@type":["{V}Order"],"{V}o_custkey":[{{{{"@id":"{BASE}customer/' || o_custkey || '"}}}}],"{V}o_orderdate":[{{{{"@value":"' || strftime(o_orderdate, '%Y-%m-%d') || '","@type":"{XSD}date"}}}}],"{V}o_orderpriority":[{{{{"@value":"' || o_orderpriority || '"}}}}],"{V}o_orderstatus":[{{{{"@value":"' || o_orderstatus || '"}}}}],"{V}o_totalprice":[{{{{"@value":"' || CAST(o_totalprice AS DECIMAL(18,2)) || '","@type":"{XSD}decimal"}}}}]}}}}'""".replace("{{", "{").replace("}}", "}")


@query(f"SELECT '{BASE}orders/' || o_orderkey AS s, {_OBJECT} AS text FROM orders")
def jsonld_node_objects(spark, d):
    """A node object for every order, members in order."""
    from ..sources import jsonld

    return jsonld.node_objects(quads(spark, d, "orders")).select("s", "text")


@query(f"""WITH c AS (SELECT conv_id, string_agg('{{"@value":' || CAST(to_json(role) AS VARCHAR) || '}}', ',' ORDER BY turn) AS items FROM conversations GROUP BY conv_id)
SELECT '{BASE}conv/' || conv_id AS s, '{{"@id":"{BASE}conv/' || conv_id || '","{V}note":[{{"{V}of":[{{"@value":"' || conv_id || '"}}]}}],"{V}turns":[{{"@list":[' || items || ']}}]}}' AS text FROM c""")
def jsonld_nested_objects(spark, d):
    """Lists and notes in place below their conversations."""
    from ..sources import jsonld

    items = containers.list_quads(_turns(spark, d, "role").select(F.concat(F.lit("conv|"), "conv").alias("head"), (F.col("n") - 1).alias("position"), "o_kind", "o", "o_dt", "o_lang"))
    none = F.lit(None).cast("string")
    row = lambda kind, s, p, o_kind, o, dt=none: F.struct(F.lit(kind).cast("byte").alias("s_kind"), s.alias("s"), F.lit(V + p).alias("p"), F.lit(o_kind).cast("byte").alias("o_kind"), o.alias("o"), dt.alias("o_dt"), none.alias("o_lang"))
    conv, note = F.concat(F.lit(BASE + "conv/"), "c"), F.concat(F.lit("note|"), "c")
    links = F.array(row(IRI, conv, "turns", BLANK, F.concat(F.lit("conv|"), "c")), row(IRI, conv, "note", BLANK, note), row(BLANK, note, "of", LITERAL, F.col("c"), F.lit(STRING)))
    q = items.unionByName(_none(read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("c")).distinct().select(F.explode(links).alias("t")).select("t.*")))
    return jsonld.node_objects(q).select("s", "text")


@query(f"SELECT {ALL} FROM q", "supplier", "nation")
def rdfxml_roundtrip(spark, d):
    from ..sources import rdfxml

    return rdfxml.parse_documents(rdfxml.documents(quads(spark, d, "supplier", "nation")))


@query(f"SELECT {ALL} FROM q", "customer", "part", "events", graphs=True)
def jelly_roundtrip(spark, d):
    """Written as binary streams and read back."""
    from ..sources import jelly

    return jelly.parse_documents(jelly.documents(quads(spark, d, "customer", "part", "events", graphs=True)))

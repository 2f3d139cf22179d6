"""All queries of the graph engine over the driver's tables, with their oracle SQL.

Main graph: parts and suppliers that share a line item; vertex 2 * key for parts and 2 * key + 1 for suppliers.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewise.functions import codecs, intlists
from edgewise.functions.session import checkpoint_dir, cut, prepare
from edgewise.operators import generators, matrix, primitives, traverse
from edgewise.operators.validate import depths_from_parents, distances_differ, gather, queue_check, scatter, validate
from edgewise.plans import stats
from edgewise.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
Q = Callable[[SparkSession, str], DataFrame]

RAW = "raw AS (SELECT 2 * l_partkey AS src, 2 * l_suppkey + 1 AS dst FROM lineitem)"
BOTH = RAW + ", both_ways AS (SELECT src, dst FROM raw UNION ALL SELECT dst, src FROM raw)"
ADJ = BOTH + ", adj AS (SELECT DISTINCT src, dst FROM both_ways WHERE src <> dst)"
DEG = ADJ + ", deg AS (SELECT src AS vertex, count(*) AS degree FROM adj GROUP BY src)"
#: Levels that the oracle follows; the searches of these graphs end before.
BOUND = 12


def bfs_sql(roots: str, adjacency: str = ADJ, bound: int = BOUND) -> str:
    """Depths by bounded recursion, then the smallest parent on the level before."""
    return f"""WITH RECURSIVE {adjacency}, roots AS ({roots}),
walk AS (SELECT root, root AS vertex, 0 AS depth FROM roots UNION SELECT root, dst, depth + 1 FROM walk JOIN adj ON src = vertex WHERE depth < {bound}),
depths AS (SELECT root, vertex, min(depth) AS depth FROM walk GROUP BY root, vertex),
tree AS (SELECT d.root, d.vertex, CASE WHEN d.depth = 0 THEN d.root ELSE min(p.vertex) END AS parent, d.depth FROM depths d
  LEFT JOIN adj ON adj.dst = d.vertex LEFT JOIN depths p ON p.root = d.root AND p.vertex = adj.src AND p.depth = d.depth - 1 GROUP BY d.root, d.vertex, d.depth)
"""


FIRST = "SELECT min(src) AS root FROM adj"
KEYS = "SELECT DISTINCT src AS root FROM adj ORDER BY src LIMIT 16"


def joined(xs) -> F.Column:
    """A list as text, so that results compare alike in every engine."""
    return F.array_join(xs.cast("array<string>"), ",")


def query(sql: str | None = None) -> Callable[[Q], Q]:
    def add(function: Q) -> Q:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_partkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"))


def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.clean(raw_edges(spark, sf_dir))


def kept_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.dealt(adjacency(spark, sf_dir))


def first_root(adj: DataFrame) -> DataFrame:
    return adj.agg(F.min("src").alias("root"))


def searched(spark: SparkSession, sf_dir: str, roots: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    adj = kept_adjacency(spark, sf_dir)
    keys = cut(first_root(adj) if roots == 1 else traverse.search_keys(matrix.degrees(adj), roots))
    return adj, keys, traverse.multi_bfs(adj, keys, is_dealt=True)


# Traversal.
@query(bfs_sql(FIRST) + "SELECT depth, count(*) AS discovered FROM tree GROUP BY depth")
def bfs_levels(spark, sf_dir):
    return traverse.level_counts(searched(spark, sf_dir)[2].drop("root"))


@query(bfs_sql(FIRST) + "SELECT vertex, parent, depth FROM tree")
def bfs_tree(spark, sf_dir):
    return searched(spark, sf_dir)[2].drop("root")


@query(bfs_sql(KEYS) + "SELECT root, vertex, parent, depth FROM tree")
def multi_bfs(spark, sf_dir):
    return searched(spark, sf_dir, 16)[2]


@query(bfs_sql(KEYS) + "SELECT root, depth, count(*) AS discovered FROM tree GROUP BY root, depth")
def level_counts(spark, sf_dir):
    return traverse.level_counts(searched(spark, sf_dir, 16)[2])


@query(bfs_sql(KEYS) + "SELECT root, count(*) AS reached, (max(depth) + 1)::BIGINT AS search_depth FROM tree GROUP BY root")
def search_summary(spark, sf_dir):
    return traverse.search_summary(searched(spark, sf_dir, 16)[2])


ORDER_PART = "adj AS (SELECT DISTINCT 2 * l_orderkey AS src, 2 * l_partkey + 1 AS dst FROM lineitem UNION SELECT DISTINCT 2 * l_partkey + 1, 2 * l_orderkey FROM lineitem)"


@query(bfs_sql(FIRST, ORDER_PART) + "SELECT vertex, depth FROM depths")
def bfs_distance_order_part(spark, sf_dir):
    prepare(spark)
    edges = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_orderkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"))
    adj = cut(matrix.clean(edges))
    return traverse.multi_bfs(adj, cut(first_root(adj))).select("vertex", "depth")


CUSTOMER_SUPPLIER = "adj AS (SELECT DISTINCT 2 * o_custkey AS src, 2 * l_suppkey + 1 AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey UNION SELECT DISTINCT 2 * l_suppkey + 1, 2 * o_custkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


@query(bfs_sql(FIRST, CUSTOMER_SUPPLIER) + "SELECT depth, count(*) AS discovered FROM tree GROUP BY depth")
def bfs_customer_supplier(spark, sf_dir):
    prepare(spark)
    orders, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    edges = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select((F.col("o_custkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"))
    adj = cut(matrix.clean(edges))
    return traverse.level_counts(traverse.multi_bfs(adj, cut(first_root(adj))).drop("root"))


USER_EVENT = "adj AS (SELECT DISTINCT 2 * user_id AS src, 2 * ascii(event_type) + 1 AS dst FROM events UNION SELECT DISTINCT 2 * ascii(event_type) + 1, 2 * user_id FROM events)"


@query(bfs_sql(FIRST, USER_EVENT) + "SELECT depth, count(*) AS discovered FROM tree GROUP BY depth")
def bfs_user_event(spark, sf_dir):
    prepare(spark)
    edges = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") * 2).alias("src"), (F.ascii("event_type") * 2 + 1).cast("long").alias("dst"))
    adj = cut(matrix.clean(edges))
    return traverse.level_counts(traverse.multi_bfs(adj, cut(first_root(adj))).drop("root"))


@query(bfs_sql("SELECT DISTINCT src AS root FROM adj ORDER BY src LIMIT 2") + ", u AS (SELECT DISTINCT vertex FROM depths WHERE depth = 2), n AS (SELECT max(src) // 4 + 1 AS width FROM adj) SELECT vertex, (vertex // width)::INTEGER AS slice FROM u, n")
def frontier_union_slice(spark, sf_dir):
    """The united third frontiers of two searches, cut into four slices that hold all vertices."""
    adj, _, tree = searched(spark, sf_dir, 2)
    tree = cut(tree.where("depth = 2"))
    most = adj.agg(F.max("src")).first()[0]
    first, last = tree.agg(F.min("root"), F.max("root")).first()
    frontier = cut(traverse.frontier_union(tree.where(F.col("root") == first), tree.where(F.col("root") == last)))
    width = most // 4 + 1
    slices = [traverse.frontier_slice(frontier, k * width, (k + 1) * width).select("vertex", F.lit(k).alias("slice")) for k in range(4)]
    return functools.reduce(DataFrame.union, slices)


@query("WITH " + DEG + " SELECT count(*) AS marked FROM deg WHERE vertex > 0")
def frontier_bitmap(spark, sf_dir):
    bits = traverse.frontier_bitmap(matrix.degrees(adjacency(spark, sf_dir)).where("vertex > 0"))
    return bits.agg(F.sum(F.bitmap_count("bits")).alias("marked"))


@query("WITH " + DEG + " SELECT vertex AS root FROM deg WHERE degree > 0 ORDER BY vertex LIMIT 64")
def search_keys(spark, sf_dir):
    return traverse.search_keys(matrix.degrees(adjacency(spark, sf_dir)), 64)


# Matrix construction.
@query("WITH " + BOTH + " SELECT src, dst, count(*) AS times FROM both_ways GROUP BY src, dst")
def symmetrize(spark, sf_dir):
    return matrix.symmetrize(raw_edges(spark, sf_dir)).groupBy("src", "dst").agg(F.count("*").alias("times"))


@query("WITH " + ADJ + " SELECT src, dst FROM adj")
def dedup_edges(spark, sf_dir):
    return adjacency(spark, sf_dir)


@query("WITH " + RAW + " SELECT DISTINCT src, dst FROM raw WHERE src <> dst")
def directed_edges(spark, sf_dir):
    return matrix.clean(raw_edges(spark, sf_dir), undirected=False)


@query("WITH " + ADJ + " SELECT (SELECT count(*) FROM raw) AS generated, (SELECT count(*) FROM raw WHERE src = dst) AS self_loops, count(*) AS unique_directed, (SELECT count(*) FROM raw) - count(*) // 2 AS removed FROM adj")
def removed_report(spark, sf_dir):
    return matrix.removed_report(raw_edges(spark, sf_dir))


@query("WITH " + RAW + " SELECT (ceil((greatest(max(src), max(dst)) + 1) / 8.0) * 8)::BIGINT AS vertices FROM raw")
def vertex_count(spark, sf_dir):
    return matrix.vertex_count(raw_edges(spark, sf_dir), 8)


@query("WITH " + DEG + " SELECT vertex, degree FROM deg")
def degrees(spark, sf_dir):
    return matrix.degrees(adjacency(spark, sf_dir))


@query("WITH " + DEG + " SELECT vertex, degree, coalesce(sum(degree) OVER (ORDER BY vertex ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS row_start FROM deg")
def row_pointer(spark, sf_dir):
    return matrix.row_pointer(adjacency(spark, sf_dir))


@query("WITH " + ADJ + " SELECT src, array_to_string(list_sort(list(dst)), ',') AS neighbors FROM adj GROUP BY src")
def adjacency_lists(spark, sf_dir):
    return matrix.adjacency_lists(adjacency(spark, sf_dir)).select("src", joined(F.col("neighbors")).alias("neighbors"))


def slice_sql(x: str, n: int, parts: int) -> str:
    small, extra = divmod(n, parts)
    edge = extra * (small + 1)
    return f"(CASE WHEN {x} < {edge} THEN {x} // {small + 1} ELSE ({x} - {edge}) // {small} + {extra} END)"


GRID_VERTICES = 100_003


@query(f"WITH {ADJ}, s AS (SELECT src, dst, {slice_sql('src', GRID_VERTICES, 3)} AS row_slice, {slice_sql('dst', GRID_VERTICES, 4)} AS col_slice FROM adj) SELECT *, row_slice * 4 + col_slice AS owner FROM s")
def owner_2d(spark, sf_dir):
    return matrix.edge_owner(adjacency(spark, sf_dir), GRID_VERTICES, 3, 4)


_SMALL, _EXTRA = divmod(GRID_VERTICES, 7)


@query(f"WITH {DEG}, o AS (SELECT vertex, {slice_sql('vertex', GRID_VERTICES, 7)} AS owner FROM deg) SELECT vertex, owner, vertex - (owner * {_SMALL} + least(owner, {_EXTRA})) AS local FROM o")
def vertex_owner(spark, sf_dir):
    owned = cut(matrix.vertex_owner(matrix.degrees(adjacency(spark, sf_dir)), GRID_VERTICES, 7))
    return matrix.to_global(owned, GRID_VERTICES, 7).select("vertex", "owner", "local")


@query("WITH " + RAW + " SELECT bool_and(src >= 0 AND dst >= 0) AS not_negative, bool_and(src <= 4294967295 AND dst <= 4294967295) AS fits FROM raw")
def range_check(spark, sf_dir):
    return matrix.range_check(raw_edges(spark, sf_dir))


# Validation.
def checked(spark, sf_dir):
    adj, keys, tree = searched(spark, sf_dir, 16)
    raw = raw_edges(spark, sf_dir)
    return adj, keys, tree, validate(tree, raw, keys, 1 << 40)


@query(bfs_sql(KEYS) + "SELECT root, count(*) // 2 AS nedge, true AS valid, true AS parents_in_range, true AS root_is_own_parent, true AS no_other_own_parent, true AS depths_follow, true AS edges_span_one_level, true AS parent_edges_exist, true AS root_in_range FROM depths JOIN both_ways ON src = vertex GROUP BY root")
def validate_trees(spark, sf_dir):
    return checked(spark, sf_dir)[3]


@query(bfs_sql(KEYS) + "SELECT root, count(*) // 2 AS nedge FROM depths JOIN both_ways ON src = vertex GROUP BY root")
def visited_raw_edges(spark, sf_dir):
    return checked(spark, sf_dir)[3].select("root", "nedge")


@query(bfs_sql(KEYS) + "SELECT root, vertex, depth::BIGINT AS depth FROM tree")
def validate_depth(spark, sf_dir):
    return depths_from_parents(searched(spark, sf_dir, 16)[2])


@query("SELECT 0::BIGINT AS differing")
def distance_check(spark, sf_dir):
    adj, keys, tree = searched(spark, sf_dir, 16)
    return distances_differ(tree, depths_from_parents(tree)).agg(F.count("*").alias("differing"))


@query("WITH " + DEG + ", q AS (SELECT vertex, vertex > lag(vertex) OVER (ORDER BY vertex) AS up FROM deg) SELECT count(*) AS length, bool_and(vertex BETWEEN 0 AND 999999999) AS in_range, bool_and(coalesce(up, true)) AS increasing FROM q")
def queue_invariants(spark, sf_dir):
    return queue_check(matrix.degrees(adjacency(spark, sf_dir)).select(F.col("vertex").alias("position"), "vertex"), 10**9)


@query("WITH " + DEG + " SELECT l_orderkey AS slot, 2 * l_partkey AS position, degree AS value FROM lineitem LEFT JOIN deg ON vertex = 2 * l_partkey")
def gather_values(spark, sf_dir):
    values = matrix.degrees(adjacency(spark, sf_dir)).withColumnsRenamed({"vertex": "position", "degree": "value"})
    return gather(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("slot"), (F.col("l_partkey") * 2).alias("position")), values)


@query("SELECT c_custkey AS position, coalesce(max(o_orderkey), -1) AS value FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def scatter_values(spark, sf_dir):
    prepare(spark)
    values = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("position"), F.lit(-1).cast("long").alias("value"))
    return scatter(values, spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("position"), F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("value")))


# Statistics.
@query(bfs_sql(KEYS) + """, steps AS (SELECT root, depth + 1 AS depth, dst FROM depths JOIN adj ON src = vertex),
work AS (SELECT root, depth, count(*) AS expanded, count(DISTINCT dst) AS unique_expanded FROM steps GROUP BY root, depth),
found AS (SELECT root, depth, count(*) AS discovered FROM depths GROUP BY root, depth)
SELECT root, depth, discovered, coalesce(expanded, CASE WHEN depth = 0 THEN 1 ELSE 0 END) AS expanded, coalesce(unique_expanded, CASE WHEN depth = 0 THEN 1 ELSE 0 END) AS unique_expanded FROM found LEFT JOIN work USING (root, depth)""")
def work_histogram(spark, sf_dir):
    adj, _, tree = searched(spark, sf_dir, 16)
    return traverse.work_histogram(tree, adj)


@query("WITH " + DEG + ", b AS (SELECT floor(log2(degree))::BIGINT AS bucket FROM deg) SELECT bucket, count(*) AS vertices, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM b) AS percent FROM b GROUP BY bucket")
def degree_histogram(spark, sf_dir):
    return stats.degree_histogram(matrix.degrees(adjacency(spark, sf_dir)))


@query(bfs_sql(KEYS) + ", d AS (SELECT src AS vertex, count(*) AS degree FROM adj GROUP BY src) SELECT root, count(*) AS nodes_visited, sum(degree)::BIGINT AS edges_visited FROM depths JOIN d USING (vertex) GROUP BY root")
def visited_counts(spark, sf_dir):
    adj, _, tree = searched(spark, sf_dir, 16)
    return stats.visited_edges(tree, matrix.degrees(adj))


@query(bfs_sql(KEYS) + ", s AS (SELECT root, count(*) AS edges_visited, count(*) + 1 AS queued FROM depths JOIN adj ON src = vertex WHERE depth < (SELECT max(depth) FROM depths x WHERE x.root = depths.root) GROUP BY root), v AS (SELECT root, count(*) AS edges_visited FROM depths JOIN adj ON src = vertex GROUP BY root) SELECT s.root, queued, v.edges_visited, round(100.0::DOUBLE * (queued - v.edges_visited) / v.edges_visited, 9) AS redundant_percent FROM s JOIN v USING (root)")
def redundant_work(spark, sf_dir):
    adj, _, tree = searched(spark, sf_dir, 16)
    tree = cut(tree)
    out = stats.redundant_work(traverse.work_histogram(tree, adj), stats.visited_edges(tree, matrix.degrees(adj)))
    return out.withColumn("redundant_percent", F.round("redundant_percent", 9))


def stats_sql(source: str, digits: int = 6) -> str:
    def quartile(k: int) -> str:
        return f"CASE WHEN (n * {k}) % 4 = 0 THEN (xs[n * {k} // 4] + xs[n * {k} // 4 + 1]) / 2 ELSE xs[n * {k} // 4 + 1] END"

    names = ["min", "q1", "median", "q3", "max", "mean", "stddev", "hmean", "hstddev"]
    exprs = ["xs[1]", quartile(1), quartile(2), quartile(3), "xs[n]", "mean", "sd", "h", "sqrt(list_sum(list_transform(xs, lambda x: (1 / x - 1 / h) * (1 / x - 1 / h)))) / (n - 1) * h * h"]
    columns = ", ".join(f"round({e}, {digits}) AS {n}" for e, n in zip(exprs, names, strict=True))
    return f"WITH v AS ({source}), a AS (SELECT list_sort(list(x)) AS xs, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS sd, count(*) / sum(1 / x) AS h FROM v) SELECT n, {columns} FROM a"


def rounded(frame: DataFrame, digits: int = 6) -> DataFrame:
    return frame.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in frame.dtypes])


@query(stats_sql("SELECT o_totalprice AS x FROM orders", 4))
def search_stats(spark, sf_dir):
    prepare(spark)
    return rounded(stats.statistics(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_totalprice"), 4)


@query(stats_sql("SELECT s_suppkey::DOUBLE + 1 AS x FROM supplier"))
def quartiles(spark, sf_dir):
    prepare(spark)
    return rounded(stats.statistics(spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey + 1 AS x"), "x"))


@query("SELECT round(avg(l_quantity), 6) AS mean, round(var_samp(l_quantity), 6) AS variance, round(stddev_samp(l_quantity) / avg(l_quantity), 6) AS coefficient FROM lineitem")
def variation(spark, sf_dir):
    prepare(spark)
    return rounded(stats.variation(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_quantity"))


# Generators.
@query("WITH v AS (SELECT range AS i FROM range(2500)), s(dx, dy) AS (VALUES (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)) SELECT i AS src, i + dx + 50 * dy AS dst FROM v, s WHERE i % 50 + dx BETWEEN 0 AND 49 AND i // 50 + dy BETWEEN 0 AND 49")
def grid2d(spark, sf_dir):
    return generators.grid(spark, 50, 2)


@query("WITH v AS (SELECT range AS i FROM range(1728)), s(dx, dy, dz) AS (VALUES (0, 0, 0), (-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)) SELECT i AS src, i + dx + 12 * dy + 144 * dz AS dst FROM v, s WHERE i % 12 + dx BETWEEN 0 AND 11 AND i // 12 % 12 + dy BETWEEN 0 AND 11 AND i // 144 + dz BETWEEN 0 AND 11")
def grid3d(spark, sf_dir):
    return generators.grid(spark, 12, 3)


def mixed_sql(x: str, nodes: int, seed: int = 1) -> str:
    return f"((((({x}) * 1103515245 + {12345 + 7919 * seed}) % 2147483647 * 48271 + 11) % 2147483647 * 69621 % 2147483647) % {nodes})"


@query(f"SELECT range // 5 AS src, {mixed_sql('range', 1000)} AS dst FROM range(5000)")
def rr_graph(spark, sf_dir):
    return generators.random_out_degree(spark, 1000, 5)


@query(f"WITH e AS (SELECT {mixed_sql('range * 2', 1000)} AS src, {mixed_sql('range * 2 + 1', 1000)} AS dst FROM range(4000)) SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e")
def random_graph(spark, sf_dir):
    return generators.uniform_random(spark, 1000, 4000, undirected=True)


@query(f"SELECT range AS i, {mixed_sql('range', 500)} AS vertex FROM range(100)")
def random_vertices(spark, sf_dir):
    return generators.random_vertices(spark, 100, 500)


@query("SELECT 16384 AS generated, 140 AS self_loops, 21184 AS unique_directed, 5792 AS removed")
def kronecker_counts(spark, sf_dir):
    """Published counts of the generator at scale 10 with seeds 1 and 2."""
    return matrix.removed_report(generators.kronecker(spark, 10))


# Published counts by scale: generated, unique directed edges, removed ones.
KRONECKER_COUNTS = ((5, 512, 322, 351), (7, 2048, 1906, 1095), (8, 4096, 4304, 1944), (9, 8192, 9694, 3345), (11, 32768, 45690, 9923), (13, 131072, 204442, 28851))


@query("SELECT * FROM (VALUES " + ", ".join(f"({s}, {g}, {u}, {r})" for s, g, u, r in KRONECKER_COUNTS) + ") AS t(scale, generated, unique_directed, removed)")
def kronecker_scales(spark, sf_dir):
    reports = [matrix.removed_report(generators.kronecker(spark, s)).select(F.lit(s).alias("scale"), "generated", "unique_directed", "removed") for s, *_ in KRONECKER_COUNTS]
    return functools.reduce(DataFrame.union, reports)


@query("SELECT true AS valid, 131070::BIGINT AS nedge, 6462::BIGINT AS reached")
def kronecker_search(spark, sf_dir):
    """A validated search of the scale 13 graph from its vertex of highest degree; published count of its edges."""
    prepare(spark)
    raw = cut(generators.kronecker(spark, 13))
    adj = traverse.dealt(matrix.clean(raw))
    roots = cut(matrix.degrees(adj).orderBy(F.desc("degree"), "vertex").limit(1).select(F.col("vertex").alias("root")))
    tree = cut(traverse.multi_bfs(adj, roots, is_dealt=True))
    return validate(tree, raw, roots, 1 << 13).select("valid", "nedge", F.lit(tree.count()).alias("reached"))


@query()
def kronecker(spark, sf_dir):
    return generators.kronecker(spark, 12)


@query()
def rmat(spark, sf_dir):
    return generators.rmat(spark, 1000, 8000, undirected=True)


@query()
def toy_kronecker(spark, sf_dir):
    return generators.toy_kronecker(spark, 8)


@query()
def random_numbers(spark, sf_dir):
    return generators.random_numbers(spark, 1000)


# Primitives.
def positioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("position"), F.col("o_custkey").alias("key"), (F.col("o_custkey") % 7).alias("value"))


POSITIONED = "WITH t AS (SELECT o_orderkey AS position, o_custkey AS key, o_custkey % 7 AS value FROM orders) "


@query(POSITIONED + "SELECT sum(key)::BIGINT AS key, sum(value)::BIGINT AS value FROM t")
def reduce_sum(spark, sf_dir):
    return primitives.reduce(positioned(spark, sf_dir), ["key", "value"])


@query(POSITIONED + "SELECT max(key) AS key, bit_or(value) AS value FROM t")
def reduce_max_or(spark, sf_dir):
    rows = positioned(spark, sf_dir)
    return rows.agg(primitives.REDUCTIONS["max"](F.col("key")).alias("key"), primitives.REDUCTIONS["bit_or"](F.col("value")).alias("value"))


@query(POSITIONED + "SELECT position, key, value, sum(key) OVER w::BIGINT AS scan_key, sum(value) OVER w::BIGINT AS scan_value FROM t WINDOW w AS (ORDER BY position ROWS UNBOUNDED PRECEDING)".replace("sum(key) OVER w::BIGINT", "(sum(key) OVER w)::BIGINT").replace("sum(value) OVER w::BIGINT", "(sum(value) OVER w)::BIGINT"))
def scan_inclusive(spark, sf_dir):
    return primitives.scan(positioned(spark, sf_dir), ["key", "value"])


@query(POSITIONED + "SELECT position, key, value, coalesce(sum(value) OVER (ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS scan_value FROM t")
def scan_exclusive(spark, sf_dir):
    return primitives.scan(positioned(spark, sf_dir), ["value"], exclusive=True)


@query(POSITIONED + "SELECT position, key, value, max(key) OVER (ORDER BY position ROWS UNBOUNDED PRECEDING) AS scan_key FROM t")
def scan_max(spark, sf_dir):
    return primitives.scan(positioned(spark, sf_dir), ["key"], op="max")


@query(POSITIONED + "SELECT position, key, value FROM t ORDER BY key, position")
def radix_sort_kv(spark, sf_dir):
    return primitives.sort_pairs(positioned(spark, sf_dir))


@query(POSITIONED + "SELECT position, key, value FROM t ORDER BY (key >> 2) & 31, position")
def bitfield_sort(spark, sf_dir):
    return primitives.sort_pairs(positioned(spark, sf_dir), start_bit=2, bits=5)


# The same with each row's place in the order.
@query(POSITIONED + "SELECT position, key, value, row_number() OVER (ORDER BY key, position) - 1 AS rank FROM t")
def radix_sort_kv_ranks(spark, sf_dir):
    return primitives.pair_ranks(positioned(spark, sf_dir))


@query(POSITIONED + "SELECT position, key, value, row_number() OVER (ORDER BY (key >> 2) & 31, position) - 1 AS rank FROM t")
def bitfield_sort_ranks(spark, sf_dir):
    return primitives.pair_ranks(positioned(spark, sf_dir), start_bit=2, bits=5)


@query(POSITIONED + "SELECT position, key, value, key % 8 AS bin, row_number() OVER (ORDER BY key % 8, position) - 1 AS slot FROM t")
def bin_partition(spark, sf_dir):
    return primitives.partition_slots(positioned(spark, sf_dir), 8).select("position", "key", "value", "bin", "slot")


@query(POSITIONED + "SELECT position, key, value, CASE WHEN value IS DISTINCT FROM lag(value) OVER (ORDER BY position) OR row_number() OVER (ORDER BY position) = 1 THEN 1 ELSE 0 END AS flag FROM t")
def discontinuity(spark, sf_dir):
    return primitives.discontinuity(positioned(spark, sf_dir))


@query(POSITIONED + "SELECT position % 100 AS position, (2 * sum(value))::BIGINT AS value FROM t GROUP BY position % 100")
def allreduce_sum(spark, sf_dir):
    part = positioned(spark, sf_dir).select((F.col("position") % 100).alias("position"), "value")
    return primitives.tree_sum([part, part])


# Integer lists and codecs.
LISTS = "WITH l AS (SELECT l_partkey AS id, list_sort(list_distinct(list(l_suppkey))) AS xs, list_sort(list_distinct(list(l_orderkey))) AS ys FROM lineitem GROUP BY l_partkey) "


def part_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.groupBy(F.col("l_partkey").alias("id")).agg(F.sort_array(F.collect_set("l_suppkey")).alias("xs"), F.sort_array(F.collect_set("l_orderkey")).alias("ys"))


@query(LISTS + "SELECT id, xs[3] AS third, xs[1] AS first_one FROM l")
def list_select(spark, sf_dir):
    return part_lists(spark, sf_dir).select("id", intlists.select(F.col("xs"), 2).alias("third"), intlists.select(F.col("xs"), 0).alias("first_one"))


@query(LISTS + "SELECT id, len(list_filter(xs, lambda x: x < 40)) AS position, list_filter(xs, lambda x: x >= 40)[1] AS value, coalesce(list_position(xs, 40), 0)::BIGINT - 1 AS found FROM l")
def list_lower_bound(spark, sf_dir):
    bound = intlists.lower_bound(F.col("xs"), 40)
    return part_lists(spark, sf_dir).select("id", bound["position"].alias("position"), bound["value"].alias("value"), intlists.position(F.col("xs"), 40).alias("found"))


@query(LISTS + "SELECT id, array_to_string(list_sort(list_append(xs, 50)), ',') AS xs FROM l")
def list_insert(spark, sf_dir):
    return part_lists(spark, sf_dir).select("id", joined(intlists.insert(F.col("xs"), 50)).alias("xs"))


@query(LISTS + "SELECT id, array_to_string(list_transform(range(1, len(xs) + 1), lambda i: CASE WHEN i > 1 THEN xs[i] - xs[i - 1] ELSE xs[i] END), ',') AS d1, array_to_string(list_transform(range(1, len(xs) + 1), lambda i: CASE WHEN i > 4 THEN xs[i] - xs[i - 4] ELSE xs[i] END), ',') AS d4, array_to_string(xs, ',') AS back FROM l")
def list_delta(spark, sf_dir):
    return part_lists(spark, sf_dir).select("id", intlists.delta(F.col("xs")).alias("d1"), intlists.delta(F.col("xs"), 4).alias("d4"), "xs").select("id", joined(F.col("d1")).alias("d1"), joined(F.col("d4")).alias("d4"), joined(intlists.undelta(F.col("d4"), 4)).alias("back"))


@query(LISTS + "SELECT id, array_to_string(list_sort(list_intersect(xs, ys)), ',') AS common FROM l")
def list_intersect(spark, sf_dir):
    return part_lists(spark, sf_dir).select("id", joined(intlists.intersect(F.col("xs"), F.col("ys"))).alias("common"))


@query(LISTS + "SELECT id, array_to_string(list_sort(list_distinct(list_concat(xs, ys))), ',') AS both, array_to_string(list_sort(list_filter(xs, lambda x: NOT list_contains(ys, x))), ',') AS only_xs FROM l")
def list_union_diff(spark, sf_dir):
    return part_lists(spark, sf_dir).select("id", joined(intlists.union(F.col("xs"), F.col("ys"))).alias("both"), joined(intlists.difference(F.col("xs"), F.col("ys"))).alias("only_xs"))


@query("SELECT a.l_partkey AS id, count(DISTINCT a.l_suppkey) AS common FROM lineitem a JOIN lineitem b ON b.l_partkey = a.l_partkey + 1 AND b.l_suppkey = a.l_suppkey GROUP BY a.l_partkey")
def row_intersect(spark, sf_dir):
    prepare(spark)
    pairs = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_suppkey").distinct()
    shifted = pairs.select((F.col("l_partkey") - 1).alias("l_partkey"), "l_suppkey")
    return pairs.intersect(shifted).groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("common"))


@query(LISTS + "SELECT id, (9 + ceil(len(xs) * CASE WHEN list_max(xs) = list_min(xs) THEN 0 ELSE floor(log2(list_max(xs) - list_min(xs))) + 1 END / 8))::BIGINT AS closed_form, (9 + ceil(len(xs) * CASE WHEN list_max(xs) = list_min(xs) THEN 0 ELSE floor(log2(list_max(xs) - list_min(xs))) + 1 END / 8))::BIGINT AS encoded FROM l")
def for_size(spark, sf_dir):
    lists = part_lists(spark, sf_dir)
    return lists.select("id", intlists.frame_size(F.col("xs")).alias("closed_form"), F.octet_length(codecs.encode("xs", "for")).cast("long").alias("encoded"))


@query(LISTS + ", d AS (SELECT id, unnest(list_transform(range(1, len(ys) + 1), lambda i: ys[i] - CASE WHEN i > 1 THEN ys[i - 1] ELSE 0 END)) AS d FROM l) SELECT id, (ceil(sum(CASE WHEN d < 128 THEN 1 ELSE floor(log2(d) / 7) + 1 END) / 4) * 4)::BIGINT AS encoded FROM d GROUP BY id")
def varint_size(spark, sf_dir):
    return part_lists(spark, sf_dir).select("id", F.octet_length(codecs.encode("ys", "varint")).cast("long").alias("encoded"))


# Orders of each supplier: lists of several blocks. The sizes follow from the widths of differences alone.
LONG = """WITH o AS (SELECT DISTINCT l_suppkey AS id, l_orderkey AS x FROM lineitem),
p AS (SELECT id, x, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY id) AS n, lag(x, 1, 0) OVER w AS back_1, lag(x, 4, 0) OVER w AS back_4 FROM o WINDOW w AS (PARTITION BY id ORDER BY x)) """


def packed_sql(name: str, back: str, block: int, head: int, group: int, group_bytes: int) -> str:
    bits = f"(CASE WHEN x = {back} THEN 0 ELSE floor(log2(x - {back})) + 1 END)"
    whole = "(n - n % 128)"
    blocks = f"SELECT id, i // {block} AS b, max({bits}) AS width FROM p WHERE i < {whole} GROUP BY id, b"
    sizes = f"SELECT id, sum({block // 8} * width) AS packed FROM ({blocks}) GROUP BY id"
    tails = f"SELECT id, sum(greatest(1, ceil({bits} / 7))) AS rest FROM p WHERE i >= {whole} GROUP BY id"
    counts = f"SELECT DISTINCT id, {head} + ceil({whole} / {block} / {group}) * {group_bytes} AS headers FROM p"
    return f"SELECT id, (headers + coalesce(packed, 0) + 4 * ceil(coalesce(rest, 0) / 4))::BIGINT AS {name} FROM ({counts}) LEFT JOIN ({sizes}) USING (id) LEFT JOIN ({tails}) USING (id)"


BYTES = "(CASE WHEN x - back_1 < 256 THEN 1 ELSE floor(log2(x - back_1) / 8) + 1 END)"


@query(
    f"{LONG}, a AS ({packed_sql('bp32', 'back_1', 32, 4, 4, 4)}), b AS ({packed_sql('bp128', 'back_1', 128, 16, 16, 16)}), c AS ({packed_sql('bp128_d4', 'back_4', 128, 16, 16, 16)}),"
    f" d AS (SELECT id, (8 + ceil(max(n) / 4) + sum({BYTES}))::BIGINT AS streamvbyte, (4 * ceil((4 + ceil(max(n) / 4) + sum({BYTES})) / 4))::BIGINT AS varintgb FROM p GROUP BY id)"
    " SELECT * FROM a JOIN b USING (id) JOIN c USING (id) JOIN d USING (id)"
)
def codec_sizes(spark, sf_dir):
    names = {"bp32": "bp32", "bp128": "s4-bp128-d1", "bp128_d4": "s4-bp128-d4", "streamvbyte": "streamvbyte", "varintgb": "varintgb"}
    return supplier_lists(spark, sf_dir).select("id", *[F.octet_length(codecs.encode("xs", c)).cast("long").alias(n) for n, c in names.items()])


def supplier_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.groupBy(F.col("l_suppkey").alias("id")).agg(F.sort_array(F.collect_set("l_orderkey")).alias("xs"))


ENCODED = ("s4-bp128-d1", "s4-bp128-d4", "s4-bp128-dm", "s4-fastpfor-d2", "bp32", "varint", "streamvbyte", "varintg8iu", "for")


@query(LONG + "SELECT id, " + ", ".join(f"max(CASE WHEN i = 150 THEN x END) AS {n.replace('-', '_')}" for n in ENCODED) + " FROM p GROUP BY id")
def encoded_select(spark, sf_dir):
    return supplier_lists(spark, sf_dir).select("id", *[codecs.select_encoded(codecs.encode("xs", n), 150, n).alias(n.replace("-", "_")) for n in ENCODED])


@query(LONG + "SELECT id, " + ", ".join(f"count(*) FILTER (x < 5000) AS {n.replace('-', '_')}, min(x) FILTER (x >= 5000) AS {n.replace('-', '_')}_value" for n in ENCODED) + " FROM p GROUP BY id")
def encoded_lower_bound(spark, sf_dir):
    bounds = supplier_lists(spark, sf_dir).select("id", *[codecs.lower_bound_encoded(codecs.encode("xs", n), 5000, n).alias(n.replace("-", "_")) for n in ENCODED])
    return bounds.select("id", *[F.col(f"{n}.{f}").alias(n + end) for n in bounds.columns[1:] for f, end in (("position", ""), ("value", "_value"))])


@query(LISTS + "SELECT id, len(ys) AS length, " + ", ".join(f"true AS {n.replace('-', '_')}" for n in sorted(codecs.CODECS)) + " FROM l")
def codec_roundtrip(spark, sf_dir):
    lists = part_lists(spark, sf_dir)
    back = [(codecs.decode(codecs.encode("ys", n), n) == F.col("ys")).alias(n.replace("-", "_")) for n in codecs.all_names()]
    return lists.select("id", F.size("ys").cast("long").alias("length"), *back)


@query(LISTS + ", d AS (SELECT unnest(list_transform(range(1, len(xs) + 1), lambda i: xs[i] - CASE WHEN i > 1 THEN xs[i - 1] ELSE 0 END)) AS d FROM l), c AS (SELECT count(*) AS n FROM d GROUP BY d) SELECT round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 9) AS entropy, sum(n)::BIGINT AS total FROM c")
def delta_entropy(spark, sf_dir):
    return stats.delta_entropy(part_lists(spark, sf_dir)).withColumn("entropy", F.round("entropy", 9))


@query()
def integer_lists(spark, sf_dir):
    return generators.integer_lists(spark, 50, 200, "clustered")


@query(LISTS + "SELECT id, 32.0::DOUBLE AS copied, true AS same_threshold FROM l")
def codec_bits_per_integer(spark, sf_dir):
    """Bits of a copied integer, and a round trip through blobs that hold short lists as they are."""
    marked = codecs.encode_marked("ys", threshold=4)
    lists = part_lists(spark, sf_dir)
    return lists.select("id", codecs.bits_per_integer(codecs.encode("ys", "copy"), F.col("ys")).alias("copied"), (codecs.decode_marked(marked) == F.col("ys")).alias("same_threshold"))


# Runs.
@query("SELECT o_orderstatus AS run, metric, value FROM (SELECT o_orderstatus, 'SCALE' AS metric, count(*)::VARCHAR AS value FROM orders GROUP BY o_orderstatus UNION ALL SELECT o_orderstatus, 'mean_time', min(o_orderkey)::VARCHAR FROM orders GROUP BY o_orderstatus UNION ALL SELECT DISTINCT o_orderstatus, 'Validation', 'passed' FROM orders)")
def run_logs(spark, sf_dir):
    return logs_of(spark, sf_dir)


@query("SELECT o_orderkey AS root, o_custkey / ((o_orderkey % 97 + 1) / 8.0::DOUBLE) AS teps, o_custkey / ((o_orderkey % 97 + 1) / 8.0::DOUBLE) / 1e6::DOUBLE AS mi_edges FROM orders")
def edge_rates(spark, sf_dir):
    runs = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("root"), F.col("o_custkey").alias("nedge"), ((F.col("o_orderkey") % 97 + 1) / F.lit(8.0)).alias("seconds"))
    return stats.edge_rates(runs).select("root", "teps", "mi_edges")


@query("WITH c AS (SELECT o_orderpriority AS metric, count(*) FILTER (o_orderstatus = 'F')::DOUBLE AS value_a, count(*) FILTER (o_orderstatus = 'O')::DOUBLE AS value_b FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY o_orderpriority) SELECT metric, value_a, value_b, value_b / value_a AS ratio FROM c UNION ALL SELECT 'SCALE', 5.0, 5.0, 1.0")
def run_comparison(spark, sf_dir):
    prepare(spark)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    checks = spark.range(1).selectExpr("inline(array(struct('SCALE' AS metric, '5' AS value), struct('Validation' AS metric, 'passed' AS value)))")
    first, second = (orders.where(F.col("o_orderstatus") == status).groupBy(F.col("o_orderpriority").alias("metric")).agg(F.count("*").cast("string").alias("value")).union(checks) for status in ("F", "O"))
    return stats.compare_runs(first, second)


# Files: written to and read from the shared checkpoint folder.
def folder(spark: SparkSession) -> str:
    prepare(spark)
    return f"{checkpoint_dir(spark)}/graph-{uuid.uuid4().hex}"


@query("WITH " + ADJ + " SELECT src, dst FROM adj")
def metis_roundtrip(spark, sf_dir):
    path, adj = folder(spark), kept_adjacency(spark, sf_dir)
    files.write_metis(adj, matrix.vertex_count(adj).first()[0], path)
    return files.read_metis(spark, path)


@query("WITH " + RAW + " SELECT src, dst, src % 5 AS value FROM raw UNION ALL SELECT dst, src, src % 5 FROM raw")
def dimacs_roundtrip(spark, sf_dir):
    path, raw = folder(spark), raw_edges(spark, sf_dir).withColumn("value", F.col("src") % 5)
    files.write_dimacs(raw, matrix.vertex_count(raw).first()[0], path)
    return files.read_dimacs(spark, path, undirected=True)


@query("WITH " + RAW + " SELECT src, dst FROM raw")
def matrix_market_roundtrip(spark, sf_dir):
    path, raw = folder(spark), raw_edges(spark, sf_dir)
    files.write_matrix_market(raw, matrix.vertex_count(raw).first()[0], path)
    return files.read_matrix_market(spark, path)


@query("SELECT l_partkey AS src, l_suppkey AS dst FROM lineitem")
def parquet_edges(spark, sf_dir):
    prepare(spark)
    return files.parquet_edges(spark, f"{sf_dir}/lineitem.parquet", "l_partkey", "l_suppkey")


def logs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run logs written from order rows: one per order status."""
    path = folder(spark)
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("k"))
    lines = F.array(F.concat(F.lit("SCALE: "), "n"), F.concat(F.lit("mean_time: "), "k"), F.lit("Validation: passed"), F.lit("free text"))
    rows.select("o_orderstatus", F.array_join(lines, "\n").alias("value")).write.partitionBy("o_orderstatus").text(path)
    return files.read_log(spark, path, "o_orderstatus")


@query("SELECT o_orderstatus AS run, count(*)::VARCHAR AS scale, min(o_orderkey)::VARCHAR AS mean_time, '-' AS harmonic_mean_TEPS, '-' AS median_TEPS, '-' AS generation_time, '-' AS construction_time FROM orders GROUP BY o_orderstatus")
def run_summary(spark, sf_dir):
    return stats.summarize_runs(logs_of(spark, sf_dir))

"""Level-synchronous breadth-first search from one or many roots at once.

A level is a join of the frontier with the adjacency, an aggregation to the smallest parent, and an anti join with what has
been visited. The adjacency is dealt by source once and checkpointed so; a frontier is dealt alike, into so many parts that
its edges, many times its size, are spread over all tasks. Lineage is cut at every level. All roots share each level's job.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgewise.functions.session import cut

STRATEGIES = ("expand-contract", "contract-expand", "two-phase", "hybrid", "multi-root")


def roots_frame(spark: SparkSession, roots: list[int]) -> DataFrame:
    return spark.createDataFrame([(int(r),) for r in sorted(set(roots))], "root long")


def dealt(adjacency: DataFrame) -> DataFrame:
    """The adjacency as searches want it: dealt by source, in the shared checkpoint folder."""
    return cut(adjacency.select("src", "dst").repartition(int(adjacency.sparkSession.conf.get("spark.sql.shuffle.partitions")), "src"))


def multi_bfs(adjacency: DataFrame, roots: DataFrame, max_depth: int = 65534, metrics: list[dict] | None = None, strategy: str = "hybrid", is_dealt: bool = False) -> DataFrame:
    """root, vertex, parent, depth for all vertices reached; a root is its own parent.

    Of several parents on the level before, the smallest is taken. ``is_dealt`` says that ``dealt`` made the adjacency. ``metrics`` gets a row for each level. The strategies
    differ in other engines by when they remove duplicates and how they balance work; here they are one plan, and
    adaptive execution chooses broadcast or shuffle joins by the size of each frontier.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy: {strategy}")
    parts_of_graph = int(adjacency.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    adjacency = adjacency if is_dealt else dealt(adjacency)
    frontier = cut(roots.select("root", F.col("root").alias("vertex"), F.col("root").alias("parent"), F.lit(0).alias("depth")).distinct())
    visited, parts = frontier, 1
    for depth in range(1, max_depth + 1):
        began = time.perf_counter()
        spread = frontier.select("root", "vertex").repartition(parts_of_graph, "vertex")
        found = spread.join(adjacency, F.col("vertex") == F.col("src")).groupBy("root", F.col("dst").alias("vertex")).agg(F.min("src").alias("parent"))
        new = cut(found.join(visited.select("root", "vertex"), ["root", "vertex"], "left_anti").withColumn("depth", F.lit(depth)))
        size = new.count()
        if metrics is not None:
            metrics.append({"depth": depth, "discovered": size, "seconds": time.perf_counter() - began})
        if not size:
            break
        visited, parts, frontier = visited.union(new), parts + 1, new
        if parts >= 8:
            visited, parts = cut(visited), 1
    return visited


def bfs(adjacency: DataFrame, root: int, max_depth: int = 65534) -> DataFrame:
    return multi_bfs(adjacency, roots_frame(adjacency.sparkSession, [root]), max_depth).drop("root")


def level_counts(tree: DataFrame) -> DataFrame:
    return tree.groupBy(*[c for c in ("root", "depth") if c in tree.columns]).agg(F.count("*").alias("discovered"))


def search_summary(tree: DataFrame) -> DataFrame:
    """root, vertices reached and search depth (levels, the root's included)."""
    return tree.groupBy("root").agg(F.count("*").alias("reached"), (F.max("depth") + 1).cast("long").alias("search_depth"))


def depth_vectors(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """vertex and depths, an array with a place for each root (null: not reached); and root with its place k.

    A vector has as many places as a run has searches, so edges meet one row for a vertex and not one for each root.
    """
    places = cut(tree.select("root").distinct().withColumn("k", F.row_number().over(Window.orderBy("root")) - 1))
    size = places.count()
    known = F.map_from_entries(F.collect_list(F.struct("k", "depth")))
    rows = tree.join(F.broadcast(places), "root").groupBy("vertex").agg(known.alias("known"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(max(size, 1) - 1)), lambda k: F.element_at("known", k.cast("int")))
    return rows.select("vertex", vector.alias("depths")), places


def work_histogram(tree: DataFrame, adjacency: DataFrame) -> DataFrame:
    """root, depth, discovered, expanded (edges that led to this level), unique_expanded (distinct vertices they led to).

    Expanded edges are sums of degrees. For the distinct vertices, edges carry the depths of their sources under all roots
    at once and are dealt by their ends.
    """
    found = tree.groupBy("root", "depth").agg(F.count("*").alias("discovered"))
    degrees = adjacency.groupBy(F.col("src").alias("vertex")).agg(F.count("*").alias("degree"))
    edges = tree.join(degrees, "vertex").groupBy("root", (F.col("depth") + 1).alias("depth")).agg(F.sum("degree").alias("expanded"))
    vectors, places = depth_vectors(tree)
    parts = int(tree.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    led = adjacency.join(vectors, F.col("vertex") == F.col("src")).select("dst", "depths").repartition(parts, "dst")
    ends = led.select("dst", F.posexplode("depths").alias("k", "from")).where("from IS NOT NULL").groupBy("dst", "k", "from").agg(F.lit(1).alias("one"))
    unique = ends.groupBy("k", (F.col("from") + 1).alias("depth")).agg(F.count("*").alias("unique_expanded")).join(F.broadcast(places), "k").drop("k")
    # The root's level has one vertex that no edge led to.
    start = F.when(F.col("depth") == 0, 1).otherwise(0)
    out = found.join(edges, ["root", "depth"], "left").join(unique, ["root", "depth"], "left")
    return out.select("root", "depth", "discovered", F.coalesce("expanded", start).cast("long").alias("expanded"), F.coalesce("unique_expanded", start).cast("long").alias("unique_expanded"))


def search_keys(degrees: DataFrame, count: int, seed: int | None = None) -> DataFrame:
    """Distinct roots of degree above 0: a seeded sample, or the smallest ids without a seed. May be fewer than asked."""
    order = [F.col("vertex")] if seed is None else [F.xxhash64(F.lit(seed), "vertex"), F.col("vertex")]
    return degrees.where("degree > 0").orderBy(*order).limit(count).select(F.col("vertex").alias("root"))


def frontier_slice(frontier: DataFrame, low: int, high: int) -> DataFrame:
    """The vertices in [low, high)."""
    return frontier.where((F.col("vertex") >= low) & (F.col("vertex") < high))


def frontier_union(one: DataFrame, two: DataFrame) -> DataFrame:
    return one.select("vertex").union(two.select("vertex")).distinct()


def frontier_bitmap(frontier: DataFrame) -> DataFrame:
    """bucket, bits: 32768 vertices to a bitmap."""
    return frontier.groupBy(F.bitmap_bucket_number("vertex").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("vertex")).alias("bits"))

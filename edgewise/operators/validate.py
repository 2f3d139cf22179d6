"""Validation of breadth-first trees (root, vertex, parent, depth) against the standard rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgewise.functions.session import cut

from .traverse import depth_vectors

UNVISITED = 65535


def validate(tree: DataFrame, raw_edges: DataFrame, roots: DataFrame, vertices: int) -> DataFrame:
    """One row per root: each rule as a boolean, their conjunction, and nedge (raw edges with a visited end, halved)."""
    by_root = tree.groupBy("root").agg(
        F.bool_and(F.col("parent").between(0, vertices - 1)).alias("parents_in_range"),
        F.bool_or((F.col("vertex") == F.col("root")) & (F.col("parent") == F.col("root")) & (F.col("depth") == 0)).alias("root_is_own_parent"),
        F.bool_and((F.col("vertex") == F.col("root")) | (F.col("parent") != F.col("vertex"))).alias("no_other_own_parent"),
    )
    up = tree.select("root", F.col("vertex").alias("parent"), F.col("depth").alias("up"))
    depth = tree.join(up, ["root", "parent"], "left").groupBy("root").agg(F.bool_and((F.col("vertex") == F.col("root")) | F.coalesce(F.col("depth") == F.col("up") + 1, F.lit(False))).alias("depths_follow"))
    both = raw_edges.select("src", "dst").union(raw_edges.select("dst", "src"))
    # An edge that misses both ends of a search cannot break its rule, so edges start from visited vertices. They carry the
    # depths of both ends under all roots at once; the rows for each root are made after the joins and summed up in place.
    vectors, places = depth_vectors(tree)
    starts = vectors.select(F.col("vertex").alias("src"), F.col("depths").alias("d0"))
    ends = vectors.select(F.col("vertex").alias("dst"), F.col("depths").alias("d1"))
    span = both.join(starts, "src").join(ends, "dst", "left").select("d1", F.posexplode("d0").alias("k", "here")).where("here IS NOT NULL")
    one_level = F.abs(F.col("here") - F.coalesce(F.get("d1", F.col("k")), F.lit(UNVISITED))) <= 1
    span = span.groupBy("k").agg(F.bool_and(one_level).alias("edges_span_one_level"), F.floor(F.count("*") / 2).cast("long").alias("nedge"))
    span = span.join(F.broadcast(places), "k").drop("k")
    claimed = tree.where("vertex <> root").select("root", F.col("parent").alias("src"), F.col("vertex").alias("dst"))
    missing = claimed.join(both, ["src", "dst"], "left_anti").groupBy("root").agg(F.count("*").alias("missing_edges"))
    out = roots.join(by_root, "root", "left").join(depth, "root", "left").join(span, "root", "left").join(missing, "root", "left")
    rules = ["parents_in_range", "root_is_own_parent", "no_other_own_parent", "depths_follow", "edges_span_one_level"]
    out = out.select(
        "root", F.col("root").between(0, vertices - 1).alias("root_in_range"),
        *[F.coalesce(r, F.lit(r == "edges_span_one_level")).alias(r) for r in rules],
        F.coalesce(F.col("missing_edges") == 0, F.lit(True)).alias("parent_edges_exist"), F.coalesce("nedge", F.lit(0)).alias("nedge"),
    )
    valid = F.col("root_in_range") & F.col("parent_edges_exist")
    for r in rules:
        valid = valid & F.col(r)
    return out.withColumn("valid", valid)


def depths_from_parents(tree: DataFrame) -> DataFrame:
    """root, vertex, depth recomputed from parents alone, by doubling; vertices on cycles, behind them or cut off are left out.

    A way that is longer than the tree has rows is on a cycle; such rows leave, and those that need them with them, so there
    are about as many rounds as the number of rows has binary digits, at most.
    """
    ways = cut(tree.select("root", "vertex", F.col("parent").alias("up"), F.when(F.col("parent") == F.col("vertex"), 0).otherwise(1).cast("long").alias("depth")))
    longest = ways.count()
    while not ways.where("up <> root").isEmpty():
        above = ways.select("root", F.col("vertex").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        further = ways.join(above, ["root", "up"]).select("root", "vertex", F.col("up2").alias("up"), (F.col("depth") + F.col("more")).alias("depth"))
        # Another vertex that is its own parent is the end of a way that does not lead to the root.
        ways = cut(further.where((F.col("depth") <= longest) & ((F.col("up") != F.col("vertex")) | (F.col("up") == F.col("root")))))
    return ways.where("up = root").select("root", "vertex", "depth")


def distances_differ(one: DataFrame, two: DataFrame) -> DataFrame:
    """Vertices whose depths are not the same in both results."""
    a, b = one.select("root", "vertex", F.col("depth").alias("depth_a")), two.select("root", "vertex", F.col("depth").alias("depth_b"))
    return a.join(b, ["root", "vertex"], "full").where(~F.col("depth_a").eqNullSafe(F.col("depth_b")))


#: Positions in one range of the two-level check of a queue.
RANGE = 1 << 16


def queue_check(queue: DataFrame, vertices: int) -> DataFrame:
    """For rows (position, vertex): length, in_range, and increasing (sorted and unique).

    In two levels: within ranges of positions, then between the ends of neighbouring ranges.
    """
    rows = queue.select("position", "vertex", F.floor(F.col("position") / RANGE).alias("part"))
    rows = rows.withColumn("before", F.lag("vertex").over(Window.partitionBy("part").orderBy("position")))
    up = F.col("before").isNull() | (F.col("before") < F.col("vertex"))
    parts = rows.groupBy("part").agg(
        F.count("*").alias("n"), F.bool_and(F.col("vertex").between(0, vertices - 1)).alias("inside"), F.bool_and(up).alias("up"),
        F.min_by("vertex", "position").alias("first"), F.max_by("vertex", "position").alias("last"),
    )
    # One row for each range.
    parts = parts.withColumn("before", F.lag("last").over(Window.orderBy("part")))
    joined = F.col("up") & (F.col("before").isNull() | (F.col("before") < F.col("first")))
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("length"), F.coalesce(F.bool_and("inside"), F.lit(True)).alias("in_range"), F.coalesce(F.bool_and(joined), F.lit(True)).alias("increasing"))


def gather(requests: DataFrame, values: DataFrame) -> DataFrame:
    """For each (slot, position) the value there."""
    return requests.join(values, "position", "left").select("slot", "position", "value")


def scatter(values: DataFrame, updates: DataFrame) -> DataFrame:
    """values (position, value) after updates (position, seq, value); of several updates of a position the last wins."""
    last = updates.groupBy("position").agg(F.max_by("value", "seq").alias("new"))
    return values.join(last, "position", "left").select("position", F.coalesce("new", "value").alias("value"))

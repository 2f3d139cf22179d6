"""From raw edges (src, dst) to clean adjacency, degrees, row pointers and ownership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def symmetrize(edges: DataFrame) -> DataFrame:
    """Each edge and its reverse, loops included, so a loop counts twice."""
    return edges.select("src", "dst").union(edges.select("dst", "src"))


def drop_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def clean(edges: DataFrame, undirected: bool = True) -> DataFrame:
    """Adjacency without loops and duplicates. Loops leave before the shuffle, duplicates by partial aggregation."""
    return drop_loops(symmetrize(edges) if undirected else edges.select("src", "dst")).distinct()


def removed_report(edges: DataFrame) -> DataFrame:
    """generated, self_loops, unique_directed and removed edges."""
    raw = edges.agg(F.count("*").alias("generated"), F.count_if(F.col("src") == F.col("dst")).alias("self_loops"))
    unique = clean(edges).agg(F.count("*").alias("unique_directed"))
    # Two rows of one value each.
    return raw.join(unique, F.lit(True)).select("generated", "self_loops", "unique_directed", (F.col("generated") - F.floor(F.col("unique_directed") / 2)).cast("long").alias("removed"))


def vertex_count(edges: DataFrame, multiple_of: int = 1) -> DataFrame:
    """Greatest id plus one, rounded up to a multiple for padded grids."""
    top = F.greatest(F.max("src"), F.max("dst")) + 1
    return edges.agg((F.ceil(top / multiple_of) * multiple_of).cast("long").alias("vertices"))


def degrees(adjacency: DataFrame) -> DataFrame:
    return adjacency.groupBy(F.col("src").alias("vertex")).agg(F.count("*").alias("degree"))


def adjacency_lists(edges: DataFrame) -> DataFrame:
    """src and its sorted neighbours; duplicates and loops stay as they are."""
    return edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("neighbors"))


#: Vertices in one range of the two-level prefix sum.
RANGE = 1 << 16


def row_pointer(adjacency: DataFrame) -> DataFrame:
    """vertex, degree and the exclusive prefix sum of degrees in order of vertex.

    In two levels: sums of ranges of ids, then sums within ranges, so no task holds all vertices.
    """
    rows = degrees(adjacency).withColumn("part", F.floor(F.col("vertex") / RANGE))
    totals = rows.groupBy("part").agg(F.sum("degree").alias("total"))
    before = totals.withColumn("base", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.coalesce(F.sum("degree").over(Window.partitionBy("part").orderBy("vertex").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("within", within).join(before.select("part", "base"), "part").select("vertex", "degree", (F.col("base") + F.col("within")).alias("row_start"))


def slice_of(vertex: Column, vertices: int, slices: int) -> Column:
    """The slice of a vertex where slices differ by one at most and larger ones come first."""
    small, extra = divmod(vertices, slices)
    edge = extra * (small + 1)
    later = F.floor((vertex - edge) / max(small, 1)) + extra
    return F.when(vertex < edge, F.floor(vertex / (small + 1))).otherwise(later).cast("long")


def slice_start(index: Column, vertices: int, slices: int) -> Column:
    small, extra = divmod(vertices, slices)
    return index * small + F.least(index, F.lit(extra))


def edge_owner(edges: DataFrame, vertices: int, rows: int, columns: int) -> DataFrame:
    """Slices of the grid that own each edge: owner = row slice * columns + column slice."""
    row, column = slice_of(F.col("src"), vertices, rows), slice_of(F.col("dst"), vertices, columns)
    return edges.select("src", "dst", row.alias("row_slice"), column.alias("col_slice"), (row * columns + column).alias("owner"))


def vertex_owner(vertices_frame: DataFrame, vertices: int, slices: int) -> DataFrame:
    """vertex, owner and local index."""
    owner = slice_of(F.col("vertex"), vertices, slices)
    return vertices_frame.select("vertex", owner.alias("owner"), (F.col("vertex") - slice_start(owner, vertices, slices)).cast("long").alias("local"))


def to_global(frame: DataFrame, vertices: int, slices: int) -> DataFrame:
    """owner and local back to vertex."""
    return frame.select("owner", "local", (slice_start(F.col("owner"), vertices, slices) + F.col("local")).cast("long").alias("vertex"))


def range_check(edges: DataFrame, most: int = 2**32 - 1) -> DataFrame:
    """Whether all ids are in [0, most]."""
    return edges.agg(F.coalesce(F.bool_and((F.col("src") >= 0) & (F.col("dst") >= 0)), F.lit(True)).alias("not_negative"), F.coalesce(F.bool_and((F.col("src") <= most) & (F.col("dst") <= most)), F.lit(True)).alias("fits"))

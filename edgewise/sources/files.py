"""Graph text formats, parquet edges and run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORDS = r"\s+"


def parquet_edges(spark: SparkSession, path: str, src: str, dst: str) -> DataFrame:
    return spark.read.parquet(path).select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"))


def _checked(edges: DataFrame, header: int, what: str) -> DataFrame:
    found = edges.count()
    if found != header:
        raise ValueError(f"{what}: the header states {header} edges, the file has {found}")
    return edges


def read_dimacs(spark: SparkSession, path: str | list[str], undirected: bool = False, check: bool = True) -> DataFrame:
    """``p <type> n m`` and ``a u v w`` lines with ids from 1, as 0-based (src, dst, value); several files are splices of one graph."""
    parts = F.split(F.trim("value"), WORDS)
    lines = spark.read.text(path).select(parts.alias("p"))
    arcs = lines.where(F.get("p", F.lit(0)) == "a").select(*[(F.col("p")[k].cast("long") - 1).alias(n) for k, n in ((1, "src"), (2, "dst"))], F.coalesce(F.get("p", F.lit(3)).cast("long"), F.lit(1)).alias("value"))
    if check:
        heads = lines.where(F.get("p", F.lit(0)) == "p").select(F.col("p")[2].cast("long").alias("n"), F.col("p")[3].cast("long").alias("m"))
        total = heads.agg(F.count_distinct("n").alias("sizes"), F.sum("m").alias("m")).first()
        if total["sizes"] != 1:
            raise ValueError("DIMACS: no header, or splices that disagree on the number of vertices")
        _checked(arcs, total["m"], "DIMACS")
    return arcs.union(arcs.select("dst", "src", "value")) if undirected else arcs


def read_matrix_market(spark: SparkSession, path: str, undirected: bool = False, check: bool = True) -> DataFrame:
    """The first number of a line is the column, the second the row; an edge goes from row to column. Values are ignored."""
    lines = spark.read.text(path).where(~F.startswith(F.ltrim("value"), F.lit("%")) & (F.trim("value") != ""))
    lines = lines.withColumn("line", F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")))
    head = lines.orderBy("line").select("line", F.split(F.trim("value"), WORDS).alias("p")).first()
    rows, columns, entries = (int(x) for x in head["p"][:3])
    if rows != columns:
        raise ValueError("Matrix-Market: the matrix is not square")
    first = F.struct(F.lit(head["line"]["block"]).alias("block"), F.lit(head["line"]["at"]).alias("at"))
    p = F.split(F.trim("value"), WORDS)
    edges = lines.where(F.col("line") > first).select((p[1].cast("long") - 1).alias("src"), (p[0].cast("long") - 1).alias("dst"))
    edges = _checked(edges, entries, "Matrix-Market") if check else edges
    return edges.union(edges.select("dst", "src")) if undirected else edges


def read_metis(spark: SparkSession, path: str) -> DataFrame:
    """Line i after the header lists the neighbours of vertex i, ids from 1; blank lines are vertices without edges.

    Lines are numbered within file blocks, which are counted first; so a large file is read in parallel.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    lines = lines.where(~F.startswith(F.ltrim("value"), F.lit("%")))
    counts = lines.groupBy("file", "block").agg(F.count("*").alias("n"))
    starts = counts.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    within = F.row_number().over(Window.partitionBy("file", "block").orderBy("at"))
    numbered = lines.withColumn("within", within).join(starts, ["file", "block"]).select((F.col("base") + F.col("within") - 2).alias("src"), "value")
    head = [int(x) for x in numbered.where("src = -1").first()["value"].split()[:2]]
    to = F.explode(F.filter(F.split(F.trim("value"), WORDS), lambda x: x != ""))
    edges = numbered.where("src >= 0").select("src", to.alias("to")).select("src", (F.col("to").cast("long") - 1).alias("dst"))
    found = edges.count()
    # The header counts undirected edges, each of which is listed twice; some writers count directed ones.
    if found not in (head[1], 2 * head[1]):
        raise ValueError(f"METIS: the header states {head[1]} edges, the file lists {found}")
    return edges


def write_metis(edges: DataFrame, vertices: int, path: str) -> None:
    """Header ``n m`` with the number of directed edges, then a line per vertex with its neighbours. One ordered file set."""
    spark = edges.sparkSession
    total = edges.count()
    lists = edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("to"))
    body = spark.range(vertices).join(lists, F.col("id") == F.col("src"), "left").select("id", F.concat_ws("", F.transform(F.coalesce("to", F.array().cast("array<long>")), lambda x: F.concat((x + 1).cast("string"), F.lit(" ")))).alias("value"))
    head = spark.createDataFrame([(-1, f"{vertices} {total}")], "id long, value string")
    head.union(body).orderBy("id").select("value").write.text(path)


def write_dimacs(edges: DataFrame, vertices: int, path: str) -> None:
    """``value`` is written as the weight where there is one."""
    weight = F.col("value") if "value" in edges.columns else F.lit(1)
    body = edges.select(F.concat_ws(" ", F.lit("a"), F.col("src") + 1, F.col("dst") + 1, weight).alias("value"))
    edges.sparkSession.createDataFrame([(f"p sp {vertices} {edges.count()}",)], "value string").union(body).write.text(path)


def write_matrix_market(edges: DataFrame, vertices: int, path: str) -> None:
    head = edges.sparkSession.createDataFrame([(0, "%%MatrixMarket matrix coordinate pattern general"), (1, f"{vertices} {vertices} {edges.count()}")], "o int, value string")
    body = edges.select(F.lit(2).alias("o"), F.concat_ws(" ", F.col("dst") + 1, F.col("src") + 1).alias("value"))
    head.union(body).orderBy("o").select("value").write.text(path)


def read_log(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    """run (the file, or the partition column named), metric and value of the ``key: value`` lines of run logs."""
    pattern = r"^\s*([A-Za-z_][\w ()/-]*?)\s*:\s+(.*?)\s*$"
    lines = spark.read.text(path).select((F.col(run) if run else F.col("_metadata.file_name")).alias("run"), *[F.regexp_extract("value", pattern, k).alias(name) for k, name in ((1, "metric"), (2, "value"))])
    return lines.where("metric <> ''")

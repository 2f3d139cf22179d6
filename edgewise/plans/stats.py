"""Order and harmonic statistics, degree and work histograms, comparison of runs."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgewise.operators.primitives import sort_ranks


def statistics(runs: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """min, q1, median, q3, max, mean, stddev, hmean, hstddev of ``value`` over the searches of a run.

    A quartile is the mean of the two values around k/4 of the order where that falls between two, else the value there.
    Values are ranked in two levels, so no task holds all of them.
    """
    by = by or []
    x = F.col(value).cast("double")
    rows = runs.where(x.isNotNull()).select(*by, x.alias("x"))
    parts = rows.groupBy(*by).agg(
        F.avg("x").alias("mean"), F.stddev_samp("x").alias("stddev"), F.min("x").alias("min"), F.max("x").alias("max"),
        F.count("*").alias("n"), F.sum(1 / F.col("x")).alias("inverse"), F.sum(1 / F.col("x") / F.col("x")).alias("inverse2"),
    )
    ranked = sort_ranks(rows, [*by, "x"])
    sizes = ranked.groupBy(*by).agg(F.min("rank").alias("first"), F.count("*").alias("n"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by]
    placed = ranked.alias("r").join(F.broadcast(sizes.alias("s")) if not by else sizes.alias("s"), functools.reduce(Column.__and__, same, F.lit(True)))
    at, n = F.col("rank") - F.col("first"), F.col("n")
    picks = []
    for k in (1, 2, 3):
        upper = F.least(F.floor(n * k / 4), n - 1)
        lower = F.when(n * k % 4 == 0, upper - 1).otherwise(upper)
        picks.append(((F.max(F.when(at == upper, F.col("x"))) + F.max(F.when(at == lower, F.col("x")))) / 2).alias(f"q{k}"))
    quartiles = placed.groupBy(*[F.col(f"r.{c}").alias(c) for c in by]).agg(*picks)
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"q.{c}")) for c in by]
    parts = parts.alias("p").join(quartiles.alias("q"), functools.reduce(Column.__and__, same, F.lit(True)))
    hmean = F.col("n") / F.col("inverse")
    # Sum of squared deviations of 1/x from 1/h.
    spread = F.greatest(F.col("inverse2") - F.col("inverse") * F.col("inverse") / F.col("n"), F.lit(0.0))
    return parts.select(
        *[F.col(f"p.{c}").alias(c) for c in by], "n", "min", "q1", F.col("q2").alias("median"), "q3", "max", "mean", "stddev", hmean.alias("hmean"),
        (F.sqrt(spread) / F.nullif(F.col("n") - 1, F.lit(0)) * hmean * hmean).alias("hstddev"),
    )


def variation(runs: DataFrame, value: str) -> DataFrame:
    """Mean, sample variance and coefficient of variation."""
    x = F.col(value).cast("double")
    return runs.agg(F.avg(x).alias("mean"), F.var_samp(x).alias("variance"), (F.stddev_samp(x) / F.avg(x)).alias("coefficient"))


def degree_histogram(degrees: DataFrame) -> DataFrame:
    """bucket (-1 for degree 0, else floor of log2), vertices and their percentage."""
    bits = F.when(F.col("degree") == 0, -1).otherwise(F.char_length(F.conv(F.col("degree").cast("string"), 10, 2)) - 1)
    counts = degrees.groupBy(bits.cast("long").alias("bucket")).agg(F.count("*").alias("vertices"))
    total = counts.agg(F.sum("vertices").alias("all_vertices"))
    return counts.join(F.broadcast(total), F.lit(True)).select("bucket", "vertices", (F.lit(100.0) * F.col("vertices") / F.col("all_vertices")).alias("percent"))


def visited_edges(tree: DataFrame, adjacency_degrees: DataFrame) -> DataFrame:
    """root, nodes_visited and edges_visited (degrees of visited vertices)."""
    return tree.join(adjacency_degrees, "vertex", "left").groupBy("root").agg(F.count("*").alias("nodes_visited"), F.sum(F.coalesce("degree", F.lit(0))).alias("edges_visited"))


def redundant_work(work: DataFrame, visited: DataFrame) -> DataFrame:
    """root, queued vertices and what they exceed the edges visited by, in per cent."""
    queued = work.groupBy("root").agg(F.sum("expanded").alias("queued"))
    return queued.join(visited, "root").select("root", "queued", "edges_visited", (F.lit(100.0) * (F.col("queued") - F.col("edges_visited")) / F.col("edges_visited")).alias("redundant_percent"))


def edge_rates(runs: DataFrame) -> DataFrame:
    """Add teps (edges per second) and mi_edges (million edges per second)."""
    return runs.withColumns({"teps": F.col("nedge") / F.col("seconds"), "mi_edges": F.col("nedge") / F.col("seconds") / 1e6})


def delta_entropy(lists: DataFrame) -> DataFrame:
    """Shannon entropy in bits of the differences between neighbours in lists (id, xs)."""
    deltas = lists.select(F.explode(F.transform("xs", lambda x, i: F.when(i == 0, x).otherwise(x - F.element_at("xs", F.greatest(i, F.lit(1)))))).alias("delta"))
    counts = deltas.groupBy("delta").agg(F.count("*").alias("n"))
    sums = counts.agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("weighted"))
    return sums.select((F.log2("total") - F.col("weighted") / F.col("total")).alias("entropy"), "total")


def compare_runs(one: DataFrame, two: DataFrame) -> DataFrame:
    """Metrics (metric, value) of two valid runs of one scale, side by side with their ratio."""

    def usable(run: DataFrame) -> DataFrame:
        return run.where((F.col("metric") != "Validation") | (F.col("value") != "passed"))

    checks = {name: [r["value"] for r in run.where(F.col("metric").isin("SCALE", "Validation")).orderBy("metric").collect()] for name, run in (("first", one), ("second", two))}
    if checks["first"] != checks["second"] or "passed" not in checks["first"]:
        raise ValueError("runs must have passed validation and be of one scale")
    a, b = (usable(run).select("metric", F.expr("try_cast(value AS double)").alias(name)).where(f"{name} IS NOT NULL") for run, name in ((one, "value_a"), (two, "value_b")))
    return a.join(b, "metric", "full").select("metric", "value_a", "value_b", (F.col("value_b") / F.nullif("value_a", F.lit(0.0))).alias("ratio"))


def summarize_runs(logs: DataFrame, by: str = "SCALE") -> DataFrame:
    """Metrics (run, metric, value) as one row per value of ``by`` and run; missing metrics are ``-``."""
    keys = logs.where(F.col("metric") == by).select("run", F.col("value").alias(by.lower()))
    names = ["mean_time", "harmonic_mean_TEPS", "median_TEPS", "generation_time", "construction_time"]
    wide = logs.where(F.col("metric").isin(names)).groupBy("run").pivot("metric", names).agg(F.first("value"))
    return keys.join(wide, "run", "left").na.fill("-", names)

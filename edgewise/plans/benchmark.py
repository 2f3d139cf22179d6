"""The whole run: generate, build, choose keys, search, validate, report."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from edgewise.functions.session import cut
from edgewise.operators import generators, matrix, traverse
from edgewise.operators.validate import validate

from . import stats


@dataclass
class Report:
    """scale, edge_factor and searches as asked for; phases in seconds; rows of the searches; statistics of rates and times."""

    scale: int
    edge_factor: int
    searches: int
    phases: dict[str, float] = field(default_factory=dict)
    removed: dict[str, int] = field(default_factory=dict)
    levels: list[dict] = field(default_factory=list)
    runs: DataFrame | None = None
    teps: DataFrame | None = None

    def shares(self) -> dict[str, float]:
        """Each phase's share of the whole."""
        total = sum(self.phases.values()) or 1.0
        return {name: seconds / total for name, seconds in self.phases.items()}

    def lines(self) -> list[str]:
        """``key: value`` lines, as the log reader takes them."""
        out = {"SCALE": self.scale, "edgefactor": self.edge_factor, "num_bfs": self.searches} | self.removed | {f"{k}_time": v for k, v in self.phases.items()}
        valid = self.runs is not None and not self.runs.where("NOT valid").count()
        return [f"{k}: {v}" for k, v in (out | {"Validation": "passed" if valid else "failed"}).items()]


def run(spark: SparkSession, scale: int, edge_factor: int = 16, searches: int = 64, seed: tuple[int, int] = (1, 2), check: bool = True) -> Report:
    """All searches of a run share each level's job; a search's time is its equal share of the traversal."""
    report, began = Report(scale, edge_factor, searches), time.perf_counter()

    def lap(name: str) -> None:
        nonlocal began
        report.phases[name], began = time.perf_counter() - began, time.perf_counter()
        spark.sparkContext.setJobGroup(name, f"benchmark at scale {scale}: after {name}")

    raw = cut(generators.kronecker(spark, scale, edge_factor << scale, seed))
    lap("generation")
    adjacency = cut(matrix.clean(raw).repartition("src"))
    report.removed = matrix.removed_report(raw).first().asDict()
    lap("construction")
    roots = cut(traverse.search_keys(matrix.degrees(adjacency), searches, seed[0]))
    count = roots.count()
    lap("search_keys")
    tree = cut(traverse.multi_bfs(adjacency, roots, metrics=report.levels))
    lap("traversal")
    if check:
        checked = cut(validate(tree, raw, roots, 1 << scale))
        lap("validation")
        report.runs = stats.edge_rates(checked.selectExpr("root", f"{report.phases['traversal'] / max(1, count)}D AS seconds", "nedge", "valid"))
        report.teps = stats.statistics(report.runs, "teps")
    return report

"""Graph generators. Every edge depends on its index and the seeds only, so any partitioning gives the same graph."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewise.functions.session import prepare

EDGE = "src long, dst long"
# Modulus and multipliers of the generator's recurrence, quadrant weights in ten-thousandths, scramble masks.
MODULUS = 2**31 - 1
FIRST, LAST = 107374182, 104480
CORNER, SIDE, WHOLE = 5700, 1900, 10000
MASKS = 0x4519840211493211, 0x3050852102C843A5


def from_indices(spark: SparkSession, count: int, edges: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], names: str = EDGE) -> DataFrame:
    """Rows made from the indices 0 to count - 1, batch by batch."""
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = edges(batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[n.split()[0] for n in names.split(", ")])

    return spark.range(count).mapInArrow(run, names)


def spread_seed(one: int, two: int) -> list[int]:
    """Five nonzero state values of 30 bits from two seeds of 64 bits."""
    low = (1 << 30) - 1
    return [(one & low) + 1, (one >> 30 & low) + 1, (two & low) + 1, (two >> 30 & low) + 1, (two >> 60 << 4) + (one >> 60) + 1]


def _product(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    return [[sum(x * y for x, y in zip(row, column, strict=True)) % MODULUS for column in zip(*b, strict=True)] for row in a]


@lru_cache
def jump(exponent: int) -> tuple[tuple[int, ...], ...]:
    """The matrix of ``exponent`` steps, by squaring."""
    step = [[FIRST, 0, 0, 0, LAST]] + [[int(k == r) for k in range(5)] for r in range(4)]
    out = [[int(k == r) for k in range(5)] for r in range(5)]
    while exponent:
        if exponent & 1:
            out = _product(out, step)
        step, exponent = _product(step, step), exponent >> 1
    return tuple(map(tuple, out))


def states_at(seed: list[int], indices: np.ndarray) -> np.ndarray:
    """The state (5, n) after ``index * 2^64`` steps, for each index."""
    state = np.repeat(np.array(seed, np.uint64)[:, None], len(indices), 1)
    modulus, bit = np.uint64(MODULUS), 0
    while len(indices) and int(indices.max()) >> bit:
        on = np.flatnonzero(indices >> bit & 1)
        part = state[:, on]
        for row, weights in enumerate(jump(1 << (64 + bit))):
            total = np.zeros(len(on), np.uint64)
            for weight, values in zip(weights, part, strict=True):
                total = (total + np.uint64(weight) * values % modulus) % modulus
            state[row, on] = total
        bit += 1
    return state


def draw(state: np.ndarray) -> np.ndarray:
    """Advance all states one step in place; the new values, in [0, 2^31 - 1)."""
    new = (np.uint64(FIRST) * state[0] + np.uint64(LAST) * state[4]) % np.uint64(MODULUS)
    state[1:] = state[:-1].copy()
    state[0] = new
    return new


def draw_quadrants(state: np.ndarray) -> np.ndarray:
    """0 to 3 with the weights of the quadrants; values that would bias the remainder are drawn again."""
    biased = np.uint64(0xFFFFFFFF % WHOLE)
    value = draw(state)
    while (again := np.flatnonzero(value < biased)).size:
        part = state[:, again]
        value[again] = draw(part)
        state[:, again] = part
    value %= np.uint64(WHOLE)
    return np.select([value < SIDE, value < 2 * SIDE, value < 2 * SIDE + CORNER], [1, 2, 0], 3)


def reverse_bits(x: np.ndarray) -> np.ndarray:
    x = x.byteswap()
    for shift, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x >> np.uint64(shift) & np.uint64(mask)) | ((x & np.uint64(mask)) << np.uint64(shift))
    return x


def scramble(vertices: np.ndarray, scale: int, keys: tuple[int, int]) -> np.ndarray:
    """A permutation of [0, 2^scale): two rounds of a product and a bit reversal, all modulo 2^64."""
    wrap = (1 << 64) - 1
    v = vertices.astype(np.uint64) + np.uint64(sum(keys) & wrap)
    for key, mask in zip(keys, MASKS, strict=True):
        v = reverse_bits(v * np.uint64(key | mask)) >> np.uint64(64 - scale)
    return v.astype(np.int64)


def kronecker(spark: SparkSession, scale: int, edges: int | None = None, seed: tuple[int, int] = (1, 2)) -> DataFrame:
    """Scrambled Kronecker edges, by default 16 for each of 2^scale vertices; duplicates and loops are kept."""
    start = spread_seed(*seed)
    moved = np.array([[sum(w * v for w, v in zip(row, start, strict=True)) % MODULUS] for row in jump(50 * 2**128 + 7 * 2**64)], np.uint64)
    a, b, c, d = (int(draw(moved)[0]) for _ in range(4))
    keys = ((a * 0xFFFFFFFF + b) % 2**64, (c * 0xFFFFFFFF + d) % 2**64)

    def make(indices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        state = states_at(start, indices)
        src = np.zeros(len(indices), np.int64)
        dst = src.copy()
        for _ in range(scale):
            square = draw_quadrants(state)
            down, right = square >> 1, square & 1
            # On the diagonal only the upper half is used, so that each undirected edge has one form.
            flip = (src == dst) & (down > right)
            src, dst = 2 * src + np.where(flip, right, down), 2 * dst + np.where(flip, down, right)
        return scramble(src, scale, keys), scramble(dst, scale, keys)

    return from_indices(spark, 16 << scale if edges is None else edges, make)


def random_numbers(spark: SparkSession, count: int, seed: tuple[int, int] = (1, 2), first: int = 0) -> DataFrame:
    """Reproducible doubles in [0, 1) at positions ``first`` on; each takes two draws."""
    start = spread_seed(*seed)

    def make(indices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        state = states_at(start, indices + first)
        high = draw(state).astype(np.float64) / MODULUS
        return indices + first, high + draw(state).astype(np.float64) / MODULUS / MODULUS

    return from_indices(spark, count, make, "position long, value double")


def _streams(indices: np.ndarray, seed: int) -> Callable[[], np.ndarray]:
    """Uniform doubles in [0, 1) for each index, draw after draw (splitmix)."""
    with np.errstate(over="ignore"):
        state = indices.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0xD1342543DE82EF95 & (1 << 64) - 1)

    def next_() -> np.ndarray:
        nonlocal state
        state = state + np.uint64(0x9E3779B97F4A7C15)
        x = (state ^ (state >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53

    return next_


def rmat(spark: SparkSession, nodes: int, edges: int, a: float = 0.57, b: float = 0.19, c: float = 0.19, undirected: bool = False, seed: int = 1) -> DataFrame:
    """R-MAT: at each level a quadrant, with weights that vary by up to five per cent and are normalised again. Ids from 0."""
    levels = max(1, (nodes - 1).bit_length())

    def make(indices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        uniform = _streams(indices, seed)
        src = np.zeros(len(indices), np.int64)
        dst = src.copy()
        weights = np.repeat(np.array([[a], [b], [c], [1 - a - b - c]]), len(indices), 1)
        for _ in range(levels):
            ends = np.cumsum(weights, 0)
            place = (uniform() * ends[3] >= ends[:3]).sum(0)
            src, dst = 2 * src + (place >> 1), 2 * dst + (place & 1)
            weights = weights * np.stack([0.95 + 0.1 * uniform() for _ in range(4)])
            weights /= weights.sum(0)
        return src % nodes, dst % nodes

    out = from_indices(spark, edges, make)
    return out.union(out.select("dst", "src")) if undirected else out


def toy_kronecker(spark: SparkSession, scale: int, edges: int | None = None, seed: int = 1) -> DataFrame:
    """The form of the benchmark's definition: independent row and column bits, then symmetric, sorted and unique."""

    def make(indices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        uniform = _streams(indices, seed)
        src = np.zeros(len(indices), np.int64)
        dst = src.copy()
        for bit in range(scale):
            row = uniform() > 0.76
            column = uniform() > np.where(row, 0.05 / 0.24, 0.57 / 0.76)
            src, dst = src + (row.astype(np.int64) << bit), dst + (column.astype(np.int64) << bit)
        return src, dst

    out = from_indices(spark, 16 << scale if edges is None else edges, make)
    return out.union(out.select("dst", "src")).distinct().orderBy("src", "dst")


def _mixed(index: F.Column, seed: int, nodes: int) -> F.Column:
    """A plain arithmetic hash below ``nodes``, the same in any SQL engine, for indices and ``nodes`` below 2^61.

    All steps stay below 2^63: an index goes in as two digits of 31 bits, and more than 31 bits come out of two hashes,
    whose linear steps on the digits are independent.
    """
    prime = 2147483647
    low, high = index.bitwiseAND(prime), F.shiftrightunsigned(index, 31)

    def digit(a: int, b: int) -> F.Column:
        x = (low * a + high * b + (12345 + 7919 * seed)) % prime
        x = (x * 48271 + 11) % prime
        return x * 69621 % prime

    out = digit(1103515245, 40692)
    return (out if nodes <= prime else digit(40692, 1103515245) % (nodes // prime + 1) * prime + out) % nodes


def uniform_random(spark: SparkSession, nodes: int, edges: int, undirected: bool = False, seed: int = 1) -> DataFrame:
    """Edges between vertices drawn uniformly; loops and repeated edges are allowed."""
    out = spark.range(edges).select(_mixed(F.col("id") * 2, seed, nodes).alias("src"), _mixed(F.col("id") * 2 + 1, seed, nodes).alias("dst"))
    return out.union(out.select("dst", "src")) if undirected else out


def random_out_degree(spark: SparkSession, nodes: int, degree: int, seed: int = 1) -> DataFrame:
    """Each vertex has exactly ``degree`` random out-neighbours."""
    return spark.range(nodes * degree).select(F.floor(F.col("id") / degree).cast("long").alias("src"), _mixed(F.col("id"), seed, nodes).alias("dst"))


def grid(spark: SparkSession, width: int, dimensions: int = 2) -> DataFrame:
    """A lattice of two or three dimensions: edges to all neighbours and a loop on every vertex."""
    steps = [(0,) * dimensions] + [tuple(s if k == d else 0 for k in range(dimensions)) for d in range(dimensions) for s in (-1, 1)]
    place = [(F.floor(F.col("id") / width**d) % width).cast("long") for d in range(dimensions)]
    options = F.array(*[F.struct(*[(place[d] + s[d]).alias(f"x{d}") for d in range(dimensions)]) for s in steps])
    out = spark.range(width**dimensions).select(F.col("id").alias("src"), F.explode(options).alias("to"))
    inside = F.lit(True)
    for d in range(dimensions):
        inside = inside & F.col(f"to.x{d}").between(0, width - 1)
    return out.where(inside).select("src", sum((F.col(f"to.x{d}") * width**d for d in range(1, dimensions)), F.col("to.x0")).alias("dst"))


def random_vertices(spark: SparkSession, count: int, nodes: int, seed: int = 1) -> DataFrame:
    return spark.range(count).select(F.col("id").alias("i"), _mixed(F.col("id"), seed, nodes).alias("vertex"))


def integer_lists(spark: SparkSession, lists: int, length: int, kind: str = "uniform", bound: int = 1 << 24, seed: int = 1) -> DataFrame:
    """Sorted lists of ``length`` distinct integers below ``bound`` as (id, xs); kind: uniform, clustered or zipf."""

    def make(indices: np.ndarray) -> tuple:
        rows = []
        for index in indices.tolist():
            rng = np.random.default_rng([seed, index])
            if kind == "uniform":
                xs = np.unique(rng.integers(0, bound, 2 * length))
            elif kind == "clustered":
                starts = rng.integers(0, bound - 64, max(1, length // 8))
                xs = np.unique((starts[:, None] + np.cumsum(rng.integers(1, 4, (len(starts), 16)), 1)).ravel())
            elif kind == "zipf":
                xs = np.cumsum(np.minimum(rng.zipf(1.5, 2 * length), bound // (4 * length) or 1))
            else:
                raise ValueError(f"kind: {kind}")
            while len(xs) < length:
                xs = np.unique(np.concatenate([xs, rng.integers(0, bound, length)]))
            rows.append(np.sort(rng.choice(xs, length, replace=False)).tolist())
        return indices, rows

    return from_indices(spark, lists, make, "id long, xs array<long>")

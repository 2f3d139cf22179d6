"""Golden counts, hand-made graphs, broken trees and DuckDB differentials."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from edgewise import catalog
from edgewise.functions import codecs
from edgewise.operators import generators, matrix, primitives, traverse
from edgewise.operators.validate import depths_from_parents, queue_check, scatter, validate
from edgewise.plans import benchmark, stats
from edgewise.sources import files

TABLES = "region nation customer supplier part orders lineitem events".split()
HAND = [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (5, 6), (4, 4), (0, 1)]


@pytest.fixture(scope="module")
def hand(spark):
    raw = spark.createDataFrame(HAND, "src long, dst long")
    adj = matrix.clean(raw)
    roots = traverse.roots_frame(spark, [0])
    return raw, adj, roots, traverse.multi_bfs(adj, roots)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def same(x):
    if isinstance(x, float):
        return round(x, 6)
    return str(x) if x is None else x


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_against_sql(spark, sf_dir, duck, name):
    frame = catalog.QUERIES[name](spark, sf_dir)
    got = frame.collect()
    if name not in catalog.ORACLE_SQL:
        assert got
        return
    result = duck.execute(catalog.ORACLE_SQL[name])
    names = sorted(d[0] for d in result.description)
    assert names == sorted(frame.columns)
    order = [d[0] for d in result.description]
    want = sorted((tuple(same(r[order.index(n)]) for n in names) for r in result.fetchall()), key=str)
    assert sorted((tuple(same(r[n]) for n in names) for r in got), key=str) == want


@pytest.mark.parametrize(("scale", "loops", "removed", "unique"), [(5, 55, 351, 322), (8, 86, 1944, 4304), (10, 140, 5792, 21184)])
def test_kronecker_golden_counts(spark, scale, loops, removed, unique):
    edges = generators.kronecker(spark, scale)
    assert matrix.removed_report(edges).first().asDict() == {"generated": 16 << scale, "self_loops": loops, "unique_directed": unique, "removed": removed}
    first = {5: [(23, 20), (23, 13), (29, 3)], 8: [(17, 148), (17, 73), (216, 20)], 10: [(967, 307), (623, 752), (737, 612)]}
    assert [tuple(r) for r in generators.kronecker(spark, scale, 3).collect()] == first[scale] or sorted(map(tuple, generators.kronecker(spark, scale, 3).collect())) == sorted(first[scale])


def test_hand_graph(hand):
    raw, adj, roots, tree = hand
    assert matrix.symmetrize(raw).count() == 16 and adj.count() == 12
    assert sorted((r["vertex"], r["parent"], r["depth"]) for r in tree.collect()) == [(0, 0, 0), (1, 0, 1), (2, 0, 1), (3, 1, 2), (4, 3, 3)]
    assert [r["degree"] for r in matrix.degrees(adj).orderBy("vertex").collect()] == [2, 2, 2, 3, 1, 1, 1]
    work = traverse.work_histogram(tree, adj).orderBy("depth").collect()
    assert [(r["discovered"], r["expanded"], r["unique_expanded"]) for r in work] == [(1, 1, 1), (2, 2, 2), (1, 4, 2), (1, 3, 3)]
    assert {r["bucket"]: r["vertices"] for r in stats.degree_histogram(matrix.degrees(adj)).collect()} == {0: 3, 1: 4}
    checked = validate(tree, raw, roots, 7).first()
    assert checked["valid"] and checked["nedge"] == 7
    assert sorted((r["vertex"], r["depth"]) for r in depths_from_parents(tree).collect()) == [(0, 0), (1, 1), (2, 1), (3, 2), (4, 3)]


def test_order_part_search_ends_with_its_frontier(spark, tmp_path):
    # A chain of orders and parts, deeper than any fixed bound of the oracle.
    lines = [(k, k) for k in range(10)] + [(k + 1, k) for k in range(9)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r["vertex"]: r["depth"] for r in catalog.QUERIES["bfs_distance_order_part"](spark, str(tmp_path)).collect()}
    assert got == {v: v for v in range(20)}


GOOD = {0: (0, 0), 1: (0, 1), 2: (0, 1), 3: (1, 2), 4: (3, 3)}


@pytest.mark.parametrize(
    ("change", "rule"),
    [
        ({4: (9, 3)}, "parents_in_range"), ({0: (1, 0)}, "root_is_own_parent"), ({4: (4, 3)}, "no_other_own_parent"), ({4: (3, 2)}, "depths_follow"),
        ({4: (0, 1)}, "parent_edges_exist"), ({4: None}, "edges_span_one_level"),
    ],
)
def test_broken_trees(spark, hand, change, rule):
    raw, _, roots, _ = hand
    rows = [(0, v, *x) for v, x in (GOOD | change).items() if x]
    row = validate(spark.createDataFrame(rows, "root long, vertex long, parent long, depth int"), raw, roots, 7).first()
    assert not row["valid"] and not row[rule]


@pytest.mark.parametrize(("n", "q1", "median", "q3", "hmean", "hstddev"), [(4, 1.5, 2.5, 3.5, 1.92, 0.714969), (5, 2, 3, 4, 2.189781, 0.777723), (6, 2, 3.5, 5, 2.44898, 0.840483), (7, 2, 4, 6, 2.699725, 0.902015), (8, 2.5, 4.5, 6.5, 2.943495, 0.962001), (9, 3, 5, 7, 3.181372, 1.020412)])
def test_order_statistics(spark, n, q1, median, q3, hmean, hstddev):
    row = stats.statistics(spark.range(1, n + 1), "id").first()
    assert (row["q1"], row["median"], row["q3"]) == (q1, median, q3)
    assert math.isclose(row["hmean"], hmean, abs_tol=1e-5) and math.isclose(row["hstddev"], hstddev, abs_tol=1e-5)


def test_lattices(spark):
    assert [generators.grid(spark, w).count() for w in (1, 3, 4)] == [1, 33, 64]
    assert [generators.grid(spark, w, 3).count() for w in (1, 3)] == [1, 135]
    assert generators.rmat(spark, 100, 500).where("src < 0 OR src > 99 OR dst < 0 OR dst > 99").count() == 0


@pytest.mark.parametrize("name", codecs.all_names())
def test_codecs(name):
    codec = codecs.get(name)
    rng = np.random.default_rng(3)
    clustered = np.cumsum(rng.integers(1, 32, 1 << 10))
    for xs in ([], [0], [1, 3, 5, 1039, 1045], list(range(1024)), clustered.tolist(), [2**32 - 1], [0, 5, 2**31, 2**32 - 1], sorted(rng.integers(0, 2**32, 300).tolist())):
        data = codec.encode(xs)
        assert codec.decode(data).tolist() == xs
        if xs:
            assert codec.select(data, len(xs) // 2) == xs[len(xs) // 2]
        blob = codecs.compress(xs, name)
        assert codecs.decompress(blob, name).tolist() == xs
    data, held = codec.encode([]), []
    for key in rng.integers(0, 1000, 64).tolist():
        data, held = codec.insert(data, key), sorted([*held, key])
    assert codec.decode(data).tolist() == held
    odd = codec.encode(range(1, 2944, 2))
    assert codec.lower_bound(odd, 100) == (50, 101) and codec.lower_bound(odd, 10**6)[1] is None
    with pytest.raises(ValueError):
        codec.encode([2**32])


def test_codec_sizes():
    assert len(codecs.get("varint").encode([5, 300])) == 4 and codecs.get("varint").encode([5, 300])[0] == 0x85
    assert codecs.get("vbyte").encode([300])[:2] == bytes([0x80 | 44, 2])
    assert len(codecs.get("streamvbyte").encode(range(8))) == 8 + 2 + 8


def test_list_intersection(spark):
    from edgewise.functions import intlists

    a = sorted({2**i | 3 for i in range(10, 31)} | {2**i | 1001 for i in range(10, 31)})
    b = sorted({2**i | j for i in range(10, 31) for j in range(3, 1000, 11)})
    row = spark.createDataFrame([(a, b)], "a array<long>, b array<long>").select(intlists.intersect(F.col("a"), F.col("b")).alias("c"), intlists.complement(F.array(F.lit(2).cast("long")), 1, 4).alias("d")).first()
    assert row["c"] == sorted(set(a) & set(b)) and row["d"] == [1, 3, 4]


def test_readers(spark, tmp_path):
    (tmp_path / "g.gr").write_text("c text\np sp 3 3\na 1 2 5\na 2 3 1\na 3 3 2\n")
    assert sorted(map(tuple, files.read_dimacs(spark, str(tmp_path / "g.gr")).collect())) == [(0, 1, 5), (1, 2, 1), (2, 2, 2)]
    (tmp_path / "bad.gr").write_text("p sp 3 4\na 1 2 5\n")
    with pytest.raises(ValueError):
        files.read_dimacs(spark, str(tmp_path / "bad.gr"))
    (tmp_path / "g.mtx").write_text("%%MatrixMarket\n% x\n3 3 2\n1 2 7.5\n3 1\n")
    assert sorted(map(tuple, files.read_matrix_market(spark, str(tmp_path / "g.mtx")).collect())) == [(0, 2), (1, 0)]
    (tmp_path / "w.mtx").write_text("3 2 1\n1 2\n")
    with pytest.raises(ValueError):
        files.read_matrix_market(spark, str(tmp_path / "w.mtx"))
    (tmp_path / "g.metis").write_text("% c\n4 2\n2 3 \n1\n1\n\n")
    assert sorted(map(tuple, files.read_metis(spark, str(tmp_path / "g.metis")).collect())) == [(0, 1), (0, 2), (1, 0), (2, 0)]
    (tmp_path / "run.log").write_text("SCALE: 10\nmean_time:   0.5\nnoise\nValidation: passed\n")
    log = files.read_log(spark, str(tmp_path / "run.log"))
    assert {r["metric"]: r["value"] for r in log.collect()} == {"SCALE": "10", "mean_time": "0.5", "Validation": "passed"}
    assert {r["metric"]: r["ratio"] for r in stats.compare_runs(log, log).collect()} == {"SCALE": 1.0, "mean_time": 1.0}


def test_small_operators(spark):
    queue = spark.createDataFrame([(0, 2), (1, 2), (2, 9)], "position long, vertex long")
    assert tuple(queue_check(queue, 9).first()) == (3, False, False)
    values = spark.createDataFrame([(0, 1), (1, 1)], "position long, value long")
    updates = spark.createDataFrame([(1, 1, 5), (1, 2, 7)], "position long, seq long, value long")
    assert sorted(map(tuple, scatter(values, updates).collect())) == [(0, 1), (1, 7)]
    doubles = spark.createDataFrame([(0.0,), (-0.0,), (-1.0,)], "x double")
    assert [str(r["x"]) for r in doubles.orderBy(primitives.bit_order(F.col("x"))).collect()] == ["-1.0", "-0.0", "0.0"]


def test_sort_ranks_of_all_rows(spark):
    rows = [(p, (p * 7919) % 97, p % 5) for p in range(2000)]
    frame = spark.createDataFrame(rows, "position long, key long, value long")
    for bits, order in (({}, lambda r: (r[1], r[0])), ({"start_bit": 2, "bits": 3}, lambda r: (r[1] >> 2 & 7, r[0]))):
        got = sorted(map(tuple, primitives.pair_ranks(frame, **bits).collect()), key=lambda r: r[3])
        assert got == [(*r, k) for k, r in enumerate(sorted(rows, key=order))]


def test_benchmark_run(spark):
    report = benchmark.run(spark, 7, searches=8)
    assert report.runs.where("valid").count() == 8 and report.runs.where("nedge = 2048").count() == 8
    assert report.teps.first()["n"] == 8 and "Validation: passed" in report.lines() and abs(sum(report.shares().values()) - 1) < 1e-9


def test_depths_of_broken_parents(spark):
    """Cycles, what hangs on them, vertices cut off and other roots are left out, in few rounds."""
    rows = [(0, 0, 0), (0, 1, 0), (0, 2, 3), (0, 3, 2), (0, 4, 3), (0, 5, 99), (0, 6, 6), (0, 7, 6), (0, 8, 1), *((0, k, k - 1) for k in range(100, 140)), *((7, k, k - 1) for k in range(8, 60)), (7, 7, 7)]
    got = {(r["root"], r["vertex"]): r["depth"] for r in depths_from_parents(spark.createDataFrame(rows, "root long, vertex long, parent long")).collect()}
    assert got == {(0, 0): 0, (0, 1): 1, (0, 8): 2} | {(7, k): k - 7 for k in range(7, 60)}


def test_queue_check_between_ranges(spark, monkeypatch):
    from edgewise.operators import validate as module

    monkeypatch.setattr(module, "RANGE", 3)
    for vertices, increasing in (([1, 2, 3, 4, 5, 6, 7], True), ([1, 2, 3, 3, 5, 6, 7], False), ([1, 2, 9, 4, 5, 6], False), ([5], True)):
        row = queue_check(spark.createDataFrame(list(enumerate(vertices)), "position long, vertex long"), 100).first()
        assert (row["length"], row["in_range"], row["increasing"]) == (len(vertices), True, increasing)


def test_statistics_by_group(spark):
    frame = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 7.0), (None, 5.0), (None, 6.0), ("b", None)], "g string, x double")
    got = {r["g"]: (r["n"], r["min"], r["q1"], r["median"], r["q3"], r["max"]) for r in stats.statistics(frame, "x", ["g"]).collect()}
    assert got == {"a": (4, 1.0, 1.5, 2.5, 3.5, 4.0), "b": (1, 7.0, 7.0, 7.0, 7.0, 7.0), None: (2, 5.0, 5.0, 5.5, 6.0, 6.0)}


@pytest.mark.parametrize("name", codecs.all_names())
def test_codec_batches(spark, name):
    rng, codec = np.random.default_rng(3), codecs.get(name)
    lists = [[], [0], [2**32 - 1], [7] * 300, list(range(127)), list(range(128)), list(range(129)), []]
    lists += [sorted(rng.integers(0, top, n).tolist()) for n in (3, 33, 256, 2049, 5000) for top in (10, 1 << 16, 1 << 32)]
    raw, lengths = codec.encode_lists(np.concatenate(lists).astype(np.int64), np.array([len(x) for x in lists]))
    data, ends = raw.tobytes(), np.cumsum(lengths).tolist()
    for xs, blob in zip(lists, [data[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True):
        assert codec.encode(xs) == blob
        for index in range(0, len(xs), 500):
            assert codec.select(blob, index) == xs[index]
        with pytest.raises(IndexError):
            codec.select(blob, len(xs))
        for key in (0, 8, 70000, 2**32 - 1):
            at = int(np.searchsorted(np.array(xs, np.int64), key))
            assert codec.lower_bound(blob, key) == (at, xs[at] if at < len(xs) else None)
    rows = spark.createDataFrame([(k, x) for k, x in enumerate([*lists, None])], "id int, xs array<long>")
    coded = rows.select("xs", codecs.encode("xs", name).alias("a"), codecs.encode_marked("xs", name, 100).alias("b"))
    back = coded.select("xs", codecs.decode("a", name).alias("a"), codecs.decode_marked("b", name).alias("b"), codecs.select_encoded("a", 2, name).alias("c"), codecs.lower_bound_encoded("a", 8, name).alias("d"))
    for xs, a, b, c, d in back.collect():
        assert a == b == xs
        assert c == (xs[2] if xs and len(xs) > 2 else None)
        assert d == (None if xs is None else (sum(x < 8 for x in xs), min((x for x in xs if x >= 8), default=None)))


def test_packed_layouts():
    # Every difference after the first is 1, so all blocks but the first need one bit.
    words = np.frombuffer(codecs.get("bp32").encode(range(5, 133)), "<u4").tolist()
    assert words[:2] == [128, 3 << 24 | 1 << 16 | 1 << 8 | 1] and words[5:] == [2**32 - 1] * 3
    assert sum(w << 32 * k for k, w in enumerate(words[2:5])) == sum((1 if k else 5) << 3 * k for k in range(32))
    words = np.frombuffer(codecs.get("s4-bp128-d1").encode(range(1, 129)), "<u4").tolist()
    assert words == [128, 123456, 123456, 123456, 1 << 24, 0, 0, 0, *[2**32 - 1] * 4]
    assert codecs.get("s4-bp128-dm").encode([1, 2]) == bytes(4) + (123456).to_bytes(4, "little") * 3 + bytes([0x81, 0x82, 0, 0])


def test_wide_random_ids(spark):
    far = spark.range(0, 1 << 50, 1 << 40).select(generators._mixed(F.col("id"), 1, 1 << 40).alias("x"))
    xs = [r.x for r in far.collect()]
    assert len(set(xs)) == len(xs) == 1024 and 0 <= min(xs) < 1 << 35 and (1 << 39) < max(xs) < 1 << 40


def test_primitives_keep_columns(spark):
    names = ["position", "key", "value", "scan_part", "flag_part", "previous", "edge", "bin_start", "own_value", "base_value"]
    rows = [(k, k * 5 % 3, k // 2, *["x"] * 7) for k in range(9)]
    frame = spark.createDataFrame(rows, names)
    scanned = primitives.scan(frame, ["value"])
    assert scanned.columns == [*names, "scan_value"] and [r["scan_value"] for r in scanned.orderBy("position").collect()] == np.cumsum([r[2] for r in rows]).tolist()
    flags = primitives.discontinuity(frame)
    assert flags.columns == [*names, "flag"] and [r["flag"] for r in flags.orderBy("position").collect()] == [1, 0] * 4 + [1]
    slots = primitives.partition_slots(frame, 3)
    assert [r["position"] for r in slots.orderBy("slot").collect()] == [r[0] for r in sorted(rows, key=lambda r: (r[1], r[0]))]
    assert slots.where("edge = 'x' AND bin_start = 'x'").count() == 9

"""MinHash near-duplicate detection with exact confirmation and connected components.

1. Each text becomes the set of hashes of its distinct word shingles, a signature of ``HASHES`` universal hash minima,
   and a wide hash of the whole set. Rows of equal sets form a class, a node of all that follows, whatever their doc_ids.
2. Signatures are cut into bands. In each bucket of equal bands every member is compared with the bucket's smallest
   member: first the signatures, then the full sets. Confirmed links give components, by alternating large-star and
   small-star steps.
3. What such stars can miss are links between members of a bucket that are still in different components. In a second
   pass, small buckets give those pairs and only those; large ones are compared in blocks of about ``BLOCK`` documents and
   ``BLOCK_SHINGLES`` shingles at most, where one matrix product counts the common shingles of all pairs of two blocks and
   only the links of a spanning forest come out. So no pairs of a group are emitted, and no task holds more than two blocks.

Bands of 3 rows, 24 of them, miss a pair at 0.75 once in 500 000; every pair above is missed less often. Signatures
that agree in fewer than ``LEAST_EQUAL`` places are dropped before the full comparison (at 0.75: five standard
deviations below what is expected).

Defined cases: null, empty or blank texts have the empty set and are linked with nothing; texts with fewer words than a
shingle are one shingle; very long texts are sets like others, held whole one at a time; repeated rows are one document
each in the result, in the same class; rows that share a doc_id but not their set are documents of their own, so two
components can have the same smallest doc_id; of equal smallest members, all are kept by ``near_duplicates`` and one by
``drop_near_duplicates`` (the least hash of the text, then of the other columns); rows without doc_id are linked with
nothing, have no component and are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgewise.functions.session import cut

from .common import id_and_text, stored

SHINGLE_WORDS = 5
PERCENT = 75
BANDS = 24
ROWS = 3
HASHES = BANDS * ROWS
LEAST_EQUAL = 36
#: Bits of the filter on wanted documents: 16 for each, within these bounds (8 MB at most).
FILTER_BITS = 1 << 18, 1 << 26
#: Buckets of more members than this are compared in blocks.
SMALL_BUCKET = 32
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: Classes with more than this part of all rows are fewer than this, so they are joined by broadcast.
HOT_CLASSES = 4096
#: What a class of equal sets is known by.
SET = ["n_shingles", "set_a", "set_b"]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_DRAW = np.random.Generator(np.random.PCG64(20240607))
_MULTIPLY = _DRAW.integers(0, 1 << 63, HASHES, np.uint64) << np.uint64(1) | np.uint64(1)
_ADD = _DRAW.integers(0, 1 << 63, HASHES, np.uint64)


def shingles(text: str, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text."""
    tokens = text.encode().lower().split()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    size = max(1, len(tokens) - words + 1) if tokens else 0
    out = hashes[:size].copy()
    for k in range(1, min(words, len(tokens))):
        out *= _STEP
        out ^= out >> np.uint64(31)
        out += hashes[k : k + size]
    out *= _MIX
    out ^= out >> np.uint64(29)
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])] if size else out


def signature(hashes: np.ndarray) -> np.ndarray:
    """The minima of the universal hashes (high halves of ``a * x + b`` mod 2^64)."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(hashes), 512):
        grid = hashes[lo : lo + 512] * _MULTIPLY[:, None]
        grid += _ADD[:, None]
        np.minimum(least, grid.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def set_hashes(sets: list[np.ndarray]) -> list[pa.Array]:
    """128 bits of hash for each set, as two arrays of longs."""
    halves = np.frombuffer(b"".join([xxhash.xxh3_128_digest(s.tobytes()) for s in sets]), "<i8").reshape(-1, 2)
    return [pa.array(halves[:, 0]), pa.array(halves[:, 1])]


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_a and set_b (the set's wide hash), sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text) for text in batch.column(1).to_pylist()]
            sigs = np.stack([signature(s) for s in sets]) if sets else np.zeros((0, HASHES), np.int32)
            offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * HASHES)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), *set_hashes(sets), pa.ListArray.from_arrays(offsets, pa.array(sigs.ravel()))],
                names=["doc_id", "text_hash", *SET, "sig"],
            )

    return id_and_text(docs).withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, sig array<int>")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and its full set, once for each of the ``wanted`` nodes (node, rep, set_a, set_b), from the text of doc_id ``rep``.

    A bitmap of hashed wanted ids, bounded by ``FILTER_BITS`` at any size of input, spares most other texts; the join
    after it leaves exactly the wanted ones. So no text is shuffled.
    """
    size = min(FILTER_BITS[1], max(FILTER_BITS[0], 1 << (16 * wanted.count()).bit_length()))

    def bit(column: str) -> F.Column:
        return F.pmod(F.xxhash64(column), F.lit(size))

    parts = wanted.select(bit("rep").alias("bit")).groupBy((F.col("bit") / 32768).cast("int").alias("part")).agg(F.bitmap_construct_agg(F.col("bit") % 32768).alias("bits"))
    bitmap = np.zeros(size // 8, np.uint8)
    for part, bits in parts.collect():
        bitmap[part * 4096 : part * 4096 + len(bits)] = np.frombuffer(bits, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in batches:
            bits = batch.column(2).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array((bitmap[bits >> 3] >> (bits & 7).astype(np.uint8) & 1).astype(bool)))
            sets = [shingles(text) for text in batch.column(1).to_pylist()]
            offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *set_hashes(sets), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["rep", "set_a", "set_b", "members"])

    maybe = id_and_text(docs).where("doc_id IS NOT NULL").withColumn("bit", bit("doc_id")).mapInArrow(run, "rep long, set_a long, set_b long, members array<long>")
    key = ["rep", "set_a", "set_b"]
    return cut(maybe.join(wanted.select("node", *key), key).dropDuplicates(key).select("node", "members"))


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Of pairs (u, v) those whose signatures and then whose full sets agree."""
    left, right = nodes.select(F.col("node").alias("u"), F.col("sig").alias("su")), nodes.select(F.col("node").alias("v"), F.col("sig").alias("sv"))
    equal = F.aggregate(F.zip_with("su", "sv", lambda a, b: (a == b).cast("int")), F.lit(0), lambda x, y: x + y)
    likely = cut(pairs.join(left, "u").join(right, "v").where(equal >= LEAST_EQUAL).select("u", "v"))
    wanted = likely.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    sets = shingle_sets(docs, cut(wanted.join(nodes.select("node", "rep", "set_a", "set_b"), "node")))
    left, right = sets.select(F.col("node").alias("u"), F.col("members").alias("mu")), sets.select(F.col("node").alias("v"), F.col("members").alias("mv"))
    both = F.size(F.array_intersect("mu", "mv"))
    close = 100 * both >= PERCENT * (F.size("mu") + F.size("mv") - both)
    return cut(likely.join(left, "u").join(right, "v").where(close).select("u", "v"))


def components(*links: DataFrame) -> DataFrame:
    """node and component (its smallest node), for the nodes of undirected links (u, v), by alternating stars.

    Each step is an aggregation to a node's smallest neighbour and a join back, so a hub's links are never gathered.
    """

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    def star(edges: DataFrame, large: bool) -> DataFrame:
        if large:
            sides = edges.union(edges.select("v", "u"))
            least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            out = sides.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            sides = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            least = sides.groupBy("u").agg(F.min("v").alias("m"))
            out = sides.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
        return out.where("u <> v").distinct()

    # Unions of checkpoints can fail in the optimizer, on constraints that they carry; written tables carry none.
    parts = links if len(links) == 1 else [stored(x) for x in links]
    ordered = [x.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")) for x in parts]
    edges = cut(functools.reduce(DataFrame.union, ordered).where("u <> v").distinct())
    before = state(edges)
    while before[0]:
        edges = cut(star(star(edges, True), False))
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def common_counts(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many shingles each two of these sets have in common."""
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, word, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[word] > 1
    owner, word = owner[shared], word[shared]
    order = np.argsort(word, kind="stable")
    owner, word = owner[order], word[order]
    column = np.cumsum(np.diff(word, prepend=-1) > 0) - 1 if len(word) else word
    out = np.zeros((len(sets), len(sets)), np.int32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        a, b = np.searchsorted(column, [lo, lo + columns])
        part = np.zeros((len(sets), columns), np.float32)
        part[owner[a:b], column[a:b] - lo] = 1
        out += (part @ part.T).astype(np.int32)
    return out


def block_links(blocks: DataFrame) -> DataFrame:
    """Links between components inside pairs of blocks; rows (key, i, j, block, v, c, members) come in order of (key, i, j)."""

    def links(group: list[tuple]) -> list[tuple[int, int]]:
        sets = [np.asarray(x[6], np.int64) for x in group]
        sizes = np.array([len(x) for x in sets])
        both = common_counts(sets)
        # Row by row: a whole matrix of wider integers would take several times the space.
        close = np.stack([100 * row.astype(np.int64) >= PERCENT * (n + sizes - row) for n, row in zip(sizes, both, strict=True)])
        side, c = np.array([x[3] for x in group]), np.array([x[5] for x in group])
        if group[0][1] != group[0][2]:
            close &= side[:, None] != side[None, :]
        out = []
        for a in range(len(group)):
            others = np.flatnonzero(close[a] & (c != c[a]))
            if len(others):
                labels, first = np.unique(c[others], return_index=True)
                out += [(group[a][4], group[b][4]) for b in others[first].tolist()]
                c[np.isin(c, labels)] = c[a]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []

        def emit() -> pa.RecordBatch:
            found = links(group)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for batch in batches:
            plain = [c.to_pylist() for c in batch.columns[:6]]
            for k, row in enumerate(zip(*plain, strict=True)):
                if group and row[:3] != group[0][:3]:
                    yield emit()
                    group = []
                group.append((*row, batch.column(6)[k].values.to_numpy(zero_copy_only=False)))
        if group:
            yield emit()

    return blocks.mapInArrow(run, "u long, v long")


def second_pass(members: DataFrame, found: DataFrame, tried: DataFrame, nodes: DataFrame, docs: DataFrame) -> list[DataFrame]:
    """Links between members of a bucket that are in different components after the first pass."""
    inside = members.where("size > 2").join(found, members["v"] == found["node"], "left").select("key", "u", "v", "size", "n_shingles", F.coalesce("component", "v").alias("c"))
    # All but the bucket's smallest member, which has been compared with all others; ``main`` is the largest component.
    inside = inside.where("v > u")
    parts = inside.groupBy("key", "c").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    sizes = parts.groupBy("key").agg(F.max(F.struct("n", "s", "c")).alias("top"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("parts")).where("parts > 1")

    def blocks(n: F.Column, s: F.Column) -> F.Column:
        return F.greatest(F.ceil(n / BLOCK), F.ceil(s / BLOCK_SHINGLES)).cast("int")

    top = F.col("top")
    sizes = sizes.select("key", top["c"].alias("main"), blocks(top["n"], top["s"]).alias("main_blocks"), blocks(F.col("n") - top["n"], F.col("s") - top["s"]).alias("rest_blocks"))
    open_ = cut(inside.join(sizes, "key"))
    small, large = open_.where(F.col("size") <= SMALL_BUCKET), open_.where(F.col("size") > SMALL_BUCKET)
    one, two = small.select("key", "v", "c"), small.select("key", F.col("v").alias("w"), F.col("c").alias("d"))
    pairs = one.join(two, (one["key"] == two["key"]) & (one["v"] < two["w"]) & (one["c"] != two["d"])).select(F.col("v").alias("u"), F.col("w").alias("v")).distinct()
    pairs = cut(pairs.join(tried, ["u", "v"], "left_anti"))
    out = [] if pairs.isEmpty() else [confirmed(pairs, nodes, docs)]
    if not large.isEmpty():
        # Members of the main component meet the blocks of the rest only, those of the rest meet all blocks.
        rest, main = F.col("rest_blocks"), F.col("main_blocks")
        in_main = F.col("c") == F.col("main")
        block = F.when(in_main, rest + F.pmod(F.xxhash64("v"), main)).otherwise(F.pmod(F.xxhash64("v"), rest)).cast("int")
        spread = large.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(in_main, rest).otherwise(rest + main) - 1)))
        spread = spread.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "v", "c")
        wanted = large.select(F.col("v").alias("node")).distinct()
        sets = shingle_sets(docs, cut(wanted.join(nodes.select("node", "rep", "set_a", "set_b"), "node")))
        rows = spread.join(sets, spread["v"] == sets["node"]).select("key", "i", "j", "block", "v", "c", "members")
        out.append(cut(block_links(rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")).distinct()))
    return out


def class_components(classes: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The classes' set columns, their component's least doc_id and its node, for classes of several rows or with links."""
    keys = F.array(*[F.xxhash64(F.lit(b), *[F.col("sig")[b * ROWS + r] for r in range(ROWS)]) for b in range(BANDS)])
    banded = nodes.select(F.col("node").alias("v"), "n_shingles", F.explode(keys).alias("key"))
    buckets = cut(banded.groupBy("key").agg(F.min("v").alias("u"), F.count("*").alias("size")).where("size > 1"))
    members = cut(banded.join(buckets, "key"))
    tried = cut(members.where("v > u").select("u", "v").distinct())
    links = confirmed(tried, nodes, docs)
    found = components(links)
    more = second_pass(members, found, tried, nodes, docs)
    if not all(x.isEmpty() for x in more):
        found = components(links, *more)
    linked = cut(found.join(classes.select("node", "rep"), "node"))
    least = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = linked.join(least, "component").select("node", "component", "component_id")
    moved = classes.join(linked, "node", "left").where("copies > 1 OR component IS NOT NULL")
    return moved.select(*SET, "copies", F.coalesce("component", "node").alias("component"), F.coalesce("component_id", "rep").alias("component_id"))


def decisions(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, text_hash, n_shingles, component (of its own for each group, null without links), component_id, kept."""
    signed = cut(signatures(docs))
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy(*SET).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    # Numbers that the checkpoint keeps, so they are the same wherever the classes are read.
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    # One row of each class; the doc_id is part of the key, so rows of a large class do not meet.
    chosen = [*SET, "rep"]
    nodes = cut(full.withColumnRenamed("doc_id", "rep").select(*chosen, "sig").join(classes.select(*chosen, "node"), chosen).dropDuplicates(chosen))
    moved = cut(class_components(classes, nodes, docs))
    most = signed.count() // HOT_CLASSES
    hot, cold = moved.where(F.col("copies") > most), moved.where(F.col("copies") <= most)

    def named(frame: DataFrame, prefix: str) -> DataFrame:
        return frame.select(*[F.col(c).alias(prefix + c) for c in (*SET, "component", "component_id")])

    def same(prefix: str) -> F.Column:
        return (F.col("n_shingles") == F.col(f"{prefix}n_shingles")) & (F.col("set_a") == F.col(f"{prefix}set_a")) & (F.col("set_b") == F.col(f"{prefix}set_b"))

    rows = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").drop("sig").join(F.broadcast(named(hot, "h_")), same("h_"), "left")
    # Rows of hot classes are done; a salt deals them out in the second join, where they match nothing.
    rows = rows.withColumn("salt", F.when(F.col("h_component").isNotNull(), F.xxhash64("doc_id", "text_hash")).otherwise(F.lit(0).cast("long")))
    rows = rows.join(named(cold, "c_").withColumn("c_salt", F.lit(0).cast("long")), same("c_") & (F.col("salt") == F.col("c_salt")), "left")
    component_id = F.coalesce("h_component_id", "c_component_id", "doc_id")
    rows = rows.select("doc_id", "text_hash", "n_shingles", F.coalesce("h_component", "c_component").alias("component"), component_id.alias("component_id"))
    alone = signed.where("NOT (n_shingles > 0 AND doc_id IS NOT NULL)").select("doc_id", "text_hash", "n_shingles", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    return rows.union(alone).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept (it is that document)."""
    return decisions(docs).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of one document of each group, with their columns.

    Rows are told apart by doc_id; only where a doc_id occurs more than once, by the hash of their text as well.
    """
    decided = cut(decisions(docs))
    ids = decided.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows_of_id"), F.bool_or("kept").alias("kept"))
    gone = ids.where("rows_of_id = 1 AND NOT kept").select("doc_id")
    shared = cut(ids.where("rows_of_id > 1").select("doc_id"))
    if shared.isEmpty():
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    once = docs.join(gone.union(shared), "doc_id", "left_anti").select(*docs.columns)
    # Of a doc_id's rows in one component one text stays, and one row of that text; texts without words all stay.
    chosen = decided.join(shared, "doc_id", "left_semi").where("kept")
    linked = chosen.where("n_shingles > 0").groupBy("doc_id", F.coalesce("component", "text_hash").alias("group")).agg(F.min("text_hash").alias("text_hash"))
    blank = chosen.where("n_shingles = 0").select("doc_id", "text_hash").distinct()
    wide = "_" * max(map(len, docs.columns))
    place, one, two = "place" + wide, "id" + wide, "hash" + wide
    stay = linked.select(F.col("doc_id").alias(one), F.col("text_hash").alias(two), F.lit(1).alias(place)).distinct().union(blank.withColumn("all", F.lit(1 << 30)))
    text_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    plain = [c for c in docs.columns if "map" not in docs.schema[c].dataType.simpleString()]
    rank = F.row_number().over(Window.partitionBy("doc_id", text_hash).orderBy(F.xxhash64(*plain)))
    rows = docs.join(stay, (F.col("doc_id") == F.col(one)) & (text_hash == F.col(two))).withColumn(one, rank).where(F.col(one) <= F.col(place))
    return once.union(rows.select(*docs.columns))

"""Token-id files: Re-Pair grammar compression per shard, with random access.

Documents are range-partitioned by doc_id and written in ascending order as shards of up to ``SHARD_TOKENS`` ids. In each
shard frequent adjacent id pairs are replaced by nonterminals, round after round, as long as that pays: until a round takes
away less than a ``LEAST_YIELD``-th of the symbols, or nonterminals need wider symbols than the ids, which costs more than
further rules save. A round replaces many pairs at once, the more frequent ones first where they overlap, and never across
a document's end. A shard's blob holds the rules, their expansion lengths, each document's ids and symbols, and the symbols
in as many bytes as they need, so a document is decoded without its shard's other documents, and a position within it is
found from the expansion lengths. Shards are written by Spark's own writer, as rows of parquet files in a shared folder.

Defined cases: a null or empty text is the end id alone; a very long text ends its shard, which is then longer; documents of equal doc_id are in order of their texts; rows
without doc_id come first; repeated rows are written once each; an empty table gives no shards; other columns are
ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewise.functions.session import checkpoint_dir

from .chunks import byte_level_cache, library
from .common import id_and_text

END_ID = 0
SHARD_TOKENS = 1 << 20
#: A rule takes two symbols and a length, so from so many uses on it saves more than it takes.
LEAST_COUNT = 5
#: Rules of a round, and the part of a sequence that a round must take away to be followed by another.
ROUND_RULES, LEAST_YIELD = 4096, 256
_BINS = 18
_HEAD = struct.Struct("<4sIIIIII")


def _alternate(at: np.ndarray) -> np.ndarray:
    """True for every second one of neighbouring positions, from the left of each run."""
    begins = np.flatnonzero(np.diff(at, prepend=at[:1] - 2) > 1)
    return (np.arange(len(at)) - np.repeat(begins, np.diff(begins, append=len(at)))) % 2 == 0


def _replace(seq: np.ndarray, last: np.ndarray, first_new: int, most: int, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round: the shorter sequence, its marks of document ends, and ``most`` new rules or fewer as rows (left, right).

    Pairs are counted in bins of a hash, another one each round; each bin has one pair of this round, whose occurrences are
    then counted exactly. Where pairs overlap, the more frequent one is replaced.
    """
    left, right = seq[:-1], seq[1:]
    bins = left * np.uint32(2654435761 + 2 * salt)
    bins ^= right
    bins *= np.uint32(2246822519 + 2 * salt)
    bins >>= np.uint32(32 - _BINS)
    n_bins = 1 << _BINS
    # What no rule may begin at is counted apart: ends of documents, every second one of overlapping twins.
    bins[np.flatnonzero(last[:-1])] = n_bins
    twins = np.flatnonzero(left == right)
    bins[twins[~_alternate(twins)]] = n_bins
    counts = np.bincount(bins, minlength=n_bins + 1)[:n_bins]
    # Some candidates lose their places to more frequent ones, so twice as many are looked at.
    least = max(LEAST_COUNT, int(np.partition(counts, -2 * most)[-2 * most]))
    at = np.flatnonzero(np.append(counts >= least, False)[bins])
    own = bins[at]
    owner = np.zeros(n_bins, np.int64)
    owner[own] = at
    mine = owner[own]
    same = (left[mine] == left[at]) & (right[mine] == right[at])
    at, own = at[same], own[same]
    counts = np.bincount(own, minlength=n_bins)
    often = counts[own] >= LEAST_COUNT
    at, own = at[often], own[often]
    # No two pairs are of equal weight, so that the heaviest one is replaced wherever it stands.
    weight = counts[own] * n_bins + own
    near = np.diff(at) == 1
    wins = np.ones(len(at), bool)
    wins[1:] &= ~near | (weight[1:] >= weight[:-1])
    wins[:-1] &= ~near | (weight[:-1] >= weight[1:])
    at, own = at[wins], own[wins]
    counts = np.bincount(own, minlength=n_bins)
    used = counts >= LEAST_COUNT
    if used.sum() > most:
        used[np.argsort(counts, kind="stable")[:-most]] = False
    keep = used[own]
    at, own = at[keep], own[keep]
    if not len(at):
        return seq, last, np.zeros((0, 2), np.uint32)
    number = (first_new + np.cumsum(used) - 1).astype(np.uint32)
    sample = owner[used]
    rules = np.stack([seq[sample], seq[sample + 1]], 1)
    seq, last = seq.copy(), last.copy()
    seq[at] = number[own]
    last[at] = last[at + 1]
    stays = np.ones(len(seq), bool)
    stays[at + 1] = False
    return seq[stays], last[stays], rules


def grammar(seq: np.ndarray, last: np.ndarray, ids: int, symbols: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Rounds until one takes away less than a ``LEAST_YIELD``-th of the sequence, or all ``symbols`` are in use."""
    rules: list[np.ndarray] = []
    known, size = ids, 2 * len(seq)
    while 1 < len(seq) < size - size // LEAST_YIELD and known < symbols:
        size = len(seq)
        seq, last, new = _replace(seq, last, known, min(symbols - known, ROUND_RULES), len(rules))
        if len(new):
            rules.append(new)
        known += len(new)
    return seq, last, rules


def symbol_bytes(ids: int) -> int:
    """The bytes of a symbol: as few as hold ``ids`` ids and a tenth more. More rules than fit then cost more than they save."""
    return max(1, ((ids + ids // 10).bit_length() + 7) // 8)


def _wide(values: np.ndarray, width: int) -> bytes:
    return values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def compress(documents: list[bytes], ids: int) -> bytes:
    """A shard's blob from its documents' ids (little-endian unsigned 32-bit integers); ``ids`` bounds them."""
    seq = np.frombuffer(b"".join(documents), "<u4").astype(np.uint32)
    tokens = np.array([len(d) // 4 for d in documents], np.int64)
    last = np.zeros(len(seq), bool)
    last[np.cumsum(tokens)[tokens > 0] - 1] = True
    width = symbol_bytes(ids)
    seq, last, rules = grammar(seq, last, ids, 1 << 8 * width)
    starts = np.cumsum([ids, *map(len, rules)])
    # Where each document's symbols end follows from its last mark; documents without ids have no mark.
    ends = np.zeros(len(documents), np.int64)
    ends[tokens > 0] = np.flatnonzero(last) + 1
    symbols = np.diff(np.maximum.accumulate(ends), prepend=0)
    flat = np.concatenate([np.zeros((0, 2), np.uint32), *rules])
    head = _HEAD.pack(b"RPG2", ids, len(documents), len(seq), len(flat), len(starts), width)
    parts = [starts.astype("<u4"), expansion_lengths(rules, ids)[ids:].astype("<u4"), tokens.astype("<u4"), symbols.astype("<u4")]
    return head + b"".join(p.tobytes() for p in parts) + _wide(flat.ravel(), width) + _wide(seq, width)


def expansion_lengths(rules: list[np.ndarray], ids: int) -> np.ndarray:
    """How many ids each symbol stands for; ``rules`` by rounds, as those of one round use symbols of rounds before only."""
    out = np.ones(ids, np.int64)
    for new in rules:
        out = np.concatenate([out, out[new[:, 0]] + out[new[:, 1]]])
    return out


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1 and so on, sizes[0] of them, then from starts[1] on."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class Shard:
    """Reads one blob."""

    def __init__(self, blob: bytes):
        magic, self.ids, self.documents, n_symbols, n_rules, n_starts, width = _HEAD.unpack_from(blob)
        if magic != b"RPG2":
            raise ValueError("not a shard of this format")
        at = _HEAD.size

        def take(n: int, width: int = 4) -> np.ndarray:
            nonlocal at
            out = np.zeros((n, 4), np.uint8)
            out[:, :width] = np.frombuffer(blob, np.uint8, n * width, at).reshape(n, width)
            at += n * width
            return out.reshape(-1).view("<u4")

        self.starts, self.lengths = take(n_starts), take(n_rules)
        self.tokens, self.symbols = take(self.documents), take(self.documents)
        self.rules = take(2 * n_rules, width).reshape(-1, 2)
        self.seq = take(n_symbols, width)
        self.first = np.concatenate([[0], np.cumsum(self.symbols, dtype=np.int64)])
        self._table: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all symbols in a row, where each symbol's begin, and how many they are.

        A round's rules are used ``LEAST_COUNT`` times at least, so a round adds a fraction of the shard's ids at most.
        """
        if self._table is None:
            sizes = np.concatenate([np.ones(self.ids, np.int64), self.lengths.astype(np.int64)])
            begins = np.cumsum(sizes) - sizes
            flat = np.zeros(int(sizes.sum()), np.uint32)
            flat[: self.ids] = np.arange(self.ids)
            for lo, hi in zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True):
                parts = self.rules[lo - self.ids : hi - self.ids].ravel()
                new = flat[_spread(begins[parts], sizes[parts])]
                flat[begins[lo] : begins[lo] + len(new)] = new
            self._table = flat, begins, sizes
        return self._table

    def expand(self, seq: np.ndarray) -> np.ndarray:
        """The ids that symbols stand for."""
        flat, begins, sizes = self.table()
        return flat[_spread(begins[seq], sizes[seq])]

    def document(self, k: int) -> np.ndarray:
        return self.expand(self.seq[self.first[k] : self.first[k + 1]])

    def id_at(self, k: int, position: int) -> int:
        """One id of document ``k``: expansion lengths tell the way down the rules, so nothing is expanded."""

        def size(symbol: int) -> int:
            return int(self.lengths[symbol - self.ids]) if symbol >= self.ids else 1

        seq = self.seq[self.first[k] : self.first[k + 1]].astype(np.int64)
        sizes = np.ones(len(seq), np.int64)
        sizes[seq >= self.ids] = self.lengths[seq[seq >= self.ids] - self.ids]
        ends = np.cumsum(sizes)
        at = int(np.searchsorted(ends, position, "right"))
        symbol, position = int(seq[at]), position - int(ends[at] - sizes[at])
        while symbol >= self.ids:
            one, two = self.rules[symbol - self.ids].tolist()
            symbol, position = (one, position) if position < size(one) else (two, position - size(one))
        return symbol


def write_token_files(docs: DataFrame, vocabulary: str, folder: str) -> None:
    """Encode whole texts, append the end id, and write shards in ascending doc_id order into a new ``folder``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, end = byte_level_cache(vocabulary), END_ID.to_bytes(4, "little")
        size = library(vocabulary).get_vocab_size()
        part, shard = TaskContext.get().partitionId(), 0
        doc_ids: list[int] = []
        encoded: list[bytes] = []
        held = before = 0

        def flush() -> pa.RecordBatch:
            arrays = [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([before], pa.int64()), pa.array([held], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([compress(encoded, size)], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["part", "shard", "before", "tokens", "doc_ids", "blob"])

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), cache.encode(batch.column(1)), strict=True):
                doc_ids.append(doc_id)
                encoded.append(ids + end)
                held += len(ids) // 4 + 1
                if held >= SHARD_TOKENS:
                    yield flush()
                    shard, before, doc_ids, encoded, held = shard + 1, before + held, [], [], 0
        if encoded:
            yield flush()

    ordered = id_and_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, "part int, shard int, before long, tokens long, doc_ids array<long>, blob binary").write.parquet(folder)


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and with ``with_ids`` the ids.

    A shard knows the ids before it in its partition; only one total per partition of the writer goes through the driver.
    """
    shards = spark.read.parquet(folder)
    totals = sorted(tuple(r) for r in shards.groupBy("part").agg(F.sum("tokens")).collect())
    before, rows = 0, []
    for part, tokens in totals:
        rows.append((part, before))
        before += tokens
    offsets = spark.createDataFrame(rows or [(-1, 0)], "part int, part_start long")
    placed = shards.join(F.broadcast(offsets), "part").select((F.col("before") + F.col("part_start")).alias("start"), "doc_ids", "blob")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                start, doc_ids, blob = (batch.column(k)[row].as_py() for k in range(3))
                shard = Shard(blob)
                tokens = shard.tokens.astype(np.int64)
                ends = np.cumsum(tokens)
                flat = shard.expand(shard.seq).astype("<u4").tobytes()
                ids = [flat[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), tokens.tolist(), strict=True)]
                columns = [
                    pa.array(doc_ids, pa.int64()), pa.array(start + ends - tokens, pa.int64()), pa.array(tokens, pa.int64()),
                    pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(ids, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def token_files(docs: DataFrame, vocabulary: str, folder: str | None = None) -> DataFrame:
    """Write the files and read them back. ``folder``: a new one in the shared checkpoint folder unless given."""
    spark = docs.sparkSession
    folder = folder or f"{checkpoint_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, vocabulary, folder)
    return read_token_files(spark, folder)
